"""What becomes of an image, attempt by attempt (IMG02).

Attempts are rows (image, attempt, outcome, location): a machine with the states below takes an image's attempts in order.
Attempts after an end state count for nothing. Rows are dealt by image and sorted, and the machine's state is carried from
one to the next, so an image may have any number of attempts.

    waiting    -> resolved | redirected | failed | refreshing (an HTTP error, where the address can be made anew)
    redirected -> resolved | redirected (MAX_REDIRECTS at most) | failed | refreshing
    refreshing -> resolved | redirected | failed: a second error ends it

A failed image that a page links to falls back to its description if that says something; unsafe addresses fail unasked.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REDIRECTS, MAX_BYTES, LEAST_ALT = 5, 20 << 20, 20
# Descriptions that say nothing, types that are images, private hosts.
GENERIC = ("", "image", "screenshot", "logo", "photo")
TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")

RESULT = "image_id string, state string, error string, attempts int, redirects int, location string"


class Machine:
    """One image. ``take`` gives it the next attempt."""

    def __init__(self, refreshable: bool):
        self.state, self.error, self.attempts, self.redirects, self.location, self.fresh = "waiting", None, 0, 0, None, refreshable

    @property
    def ended(self) -> bool:
        return self.state in ("resolved", "failed")

    def _fail(self, error: str) -> None:
        self.state, self.error = "failed", error

    def take(self, outcome: str, location: str | None, kind: str | None, size: int | None, animated: bool | None) -> None:
        if self.ended:
            return
        self.attempts += 1
        if outcome == "redirect":
            self.redirects += 1
            self.location = location
            if self.redirects > MAX_REDIRECTS:
                self._fail("too_many_redirects")
            elif self.state == "waiting":
                self.state = "redirected"
        elif outcome == "ok":
            if kind not in TYPES:
                self._fail("unsupported_or_non_image")
            elif animated:
                self._fail("animated_gif_unsupported")
            elif not 0 < (size or 0) <= MAX_BYTES:
                self._fail("image_too_large" if size else "unsupported_or_non_image")
            else:
                self.state = "resolved"
        elif outcome == "http_error" and self.fresh:
            self.state, self.fresh = "refreshing", False
        else:
            self._fail(outcome)


def states(attempts: DataFrame) -> DataFrame:
    """(image_id, state, error, attempts, redirects, location) of the images of ``attempts``: (image_id, refreshable, attempt, outcome, location, type, size, animated)."""

    def run(batches):
        image, machine = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["image_id"] != image:
                    if machine is not None:
                        out.append(row(image, machine))
                    image, machine = r["image_id"], Machine(bool(r["refreshable"]))
                machine.take(r["outcome"], r["location"], r["type"], r["size"], r["animated"])
            yield made(out)
        yield made([row(image, machine)] if machine is not None else [])

    def row(image, m):
        return image, m.state, m.error, m.attempts, m.redirects, m.location

    def made(rows):
        kinds = pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])

    columns = "image_id", "refreshable", "attempt", "outcome", "location", "type", "size", "animated"
    return attempts.select(*columns).repartition("image_id").sortWithinPartitions("image_id", "attempt").mapInArrow(run, RESULT)


def resolved(images: DataFrame, attempts: DataFrame) -> DataFrame:
    """(image_id, status, error_code, fallback_text, attempts, redirects, location) of every image (image_id, role, alt, unsafe)."""
    asked = images.where("NOT unsafe").select("image_id")
    found = states(attempts.join(asked, "image_id", "left_semi"))
    both = images.join(found, "image_id", "left")
    error = F.when(F.col("unsafe"), "unsafe_image_url").when(F.col("state").isNull(), "never_tried").when(F.col("state") == "resolved", None).otherwise(F.coalesce("error", F.lit("unfinished")))
    alt = F.btrim(F.coalesce("alt", F.lit("")))
    says = (F.col("role") == "document") & (error == "http_error") & (F.length(alt) >= LEAST_ALT) & ~F.lower(alt).isin(*GENERIC)
    status = F.when(error.isNull(), "resolved").when(says, "text_fallback").otherwise("failed")
    return both.select(
        "image_id", status.alias("status"), error.alias("error_code"), F.when(status == "text_fallback", alt).alias("fallback_text"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("redirects", F.lit(0)).alias("redirects"), "location",
    )
