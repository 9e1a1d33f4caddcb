"""Front matter in YAML: maps and lists by indentation or in brackets, quoted, plain and block scalars.

Not read, and therefore invalid: anchors, aliases, tags, complex keys, several documents, merge keys.
"""

from __future__ import annotations

import json
import re

# How plain scalars are typed, as YAML 1.1 does.
NULLS = {"", "~", "null", "Null", "NULL"}
BOOLEANS = {w: v for v, ws in ((True, "yes Yes YES true True TRUE on On ON"), (False, "no No NO false False FALSE off Off OFF")) for w in ws.split()}
INTEGER = re.compile(r"[-+]?(0|[1-9][0-9_]*)$")
FLOAT = re.compile(r"[-+]?([0-9][0-9_]*)?\.[0-9_]*([eE][-+][0-9]+)?$")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "a": "\a", "e": "\x1b", "v": "\v", " ": " "}

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s\[\]{}"'#&*!|>%@`,?:-]|[?:-](?=\S))(?:[^#]|(?<=\S)#)*?)\s*:(?=\s|$)""")
_FLOW = re.compile(r"(?:\s|(?<=\s)#[^\n]*)*")
_FLOW_SCALAR = re.compile(r"[^,\[\]{}]*?(?=\s*(?:[,\[\]{}]|\s#|\Z))")
_FLOW_KEY = re.compile(r"(?:[^,\[\]{}:]|:(?=[^\s,\[\]{}]))*")
_COLON = re.compile(r"\s*:")
_BREAKS = re.compile(r"[ \t]*\n[ \t\n]*")


class Invalid(ValueError):
    pass


def scalar(text: str):
    """The value of a plain scalar."""
    if text in NULLS:
        return None
    if text in BOOLEANS:
        return BOOLEANS[text]
    if INTEGER.match(text):
        return int(text.replace("_", ""))
    if FLOAT.match(text) and any(c.isdigit() for c in text):
        return float(text.replace("_", ""))
    return text


def quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted scalar that starts at ``at``, and the place after it."""
    quote, out, at = text[at], [], at + 1
    while at < len(text):
        c = text[at]
        if c == quote:
            if quote == "'" and text[at + 1 : at + 2] == "'":
                out.append("'")
                at += 2
                continue
            return "".join(out), at + 1
        if c == "\n":  # folded: one break is a blank, more are one less
            m = _BREAKS.match(text, at)
            n = m.group().count("\n")
            while out and out[-1] in (" ", "\t"):
                out.pop()
            out.append("\n" * (n - 1) if n > 1 else " ")
            at = m.end()
            continue
        if c == "\\" and quote == '"':
            e = text[at + 1 : at + 2]
            if e == "\n":
                m = _BREAKS.match(text, at + 1)
                out.append("\n" * (m.group().count("\n") - 1))
                at = m.end()
                continue
            size = {"x": 2, "u": 4, "U": 8}.get(e)
            if size:
                code = text[at + 2 : at + 2 + size]
                if not re.fullmatch(f"[0-9a-fA-F]{{{size}}}", code):
                    raise Invalid("escape")
                out.append(chr(int(code, 16)))
                at += 2 + size
                continue
            if e not in ESCAPES:
                raise Invalid("escape")
            out.append(ESCAPES[e])
            at += 2
            continue
        out.append(c)
        at += 1
    raise Invalid("quote")


def flow(text: str, at: int = 0):
    """(value in brackets or scalar that starts at ``at``, place after it). Open brackets are a stack, so depth has no limit."""
    stack: list[tuple[object, str | None]] = []  # container, key that waits for its value
    while True:
        at = _FLOW.match(text, at).end()
        c = text[at : at + 1]
        done = False
        if c == "":
            raise Invalid("end in brackets")
        if c in "[{":
            stack.append(([] if c == "[" else {}, None))
            at += 1
            at = _FLOW.match(text, at).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                if c == "{":
                    at = _flow_key(text, at, stack)
                continue
            at += 1
            value, done = stack.pop()[0], True
        elif c in "\"'":
            value, at = quoted(text, at)
            done = True
        else:
            m = _FLOW_SCALAR.match(text, at)
            word = " ".join(m.group().split()) if m else ""
            if not m or c in "&*!|>%@`#" or ": " in word or word.endswith(":"):
                raise Invalid("flow scalar")
            value, at, done = scalar(word), m.end(), True
        while done:
            if not stack:
                return value, at
            held, key = stack[-1]
            if isinstance(held, list):
                held.append(value)
            else:
                held[key] = value
            at = _FLOW.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = _FLOW.match(text, at + 1).end()
                if text[at : at + 1] not in ("]", "}"):
                    if isinstance(held, dict):
                        at = _flow_key(text, at, stack)
                    break
                c = text[at : at + 1]
            if c != ("]" if isinstance(held, list) else "}"):
                raise Invalid("bracket")
            at += 1
            value = stack.pop()[0]


def _flow_key(text: str, at: int, stack: list) -> int:
    if text[at : at + 1] in ('"', "'"):
        key, at = quoted(text, at)
    else:
        m = _FLOW_KEY.match(text, at)
        key, at = m.group().strip(), m.end()
    m = _COLON.match(text, at)
    if not m:
        raise Invalid("key in brackets")
    stack[-1] = (stack[-1][0], key)
    return m.end()


def _uncommented(text: str) -> str:
    """A line's value without its comment."""
    if text[:1] in ("'", '"', "[", "{"):
        return text
    at = 0 if text.startswith("#") else text.find(" #")
    return text if at < 0 else text[:at].rstrip()


class _Reader:
    """Lines by indentation. Open maps and lists are a stack of (indentation, container, key that waits)."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at = 0

    def read(self):
        stack: list[list] = []  # [indentation, container, key]
        root = None

        def put(value, indent=-1):
            nonlocal root
            if not stack:
                root = value
            elif isinstance(stack[-1][1], list):
                stack[-1][1].append(value)
            else:
                stack[-1][1][stack[-1][2]] = value

        def waits() -> bool:
            """Whether the innermost container lacks the value of its last key or dash."""
            return not stack or stack[-1][3]

        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            indent = len(line) - len(body)
            if not body.strip() or body.startswith("#"):
                self.at += 1
                continue
            if body.startswith("\t") or body.startswith(("---", "...")) and body.rstrip() in ("---", "..."):
                raise Invalid("line")
            dash = body == "-" or body.startswith("- ")
            while stack and (indent < stack[-1][0] or indent == stack[-1][0] and isinstance(stack[-1][1], list) and not dash):
                self._close(stack)
            while True:  # what stands on the line: dashes, a key, a value
                dash = body == "-" or body.startswith("- ")
                m = None if dash else _KEY.match(body)
                if dash or m:
                    top = stack[-1] if stack else None
                    kind = list if dash else dict
                    if top is None and root is not None:
                        raise Invalid("two roots")
                    if top is None or indent > top[0] or (dash and indent == top[0] and isinstance(top[1], dict) and top[3]):
                        if not waits():
                            raise Invalid("indentation")
                        made = kind()
                        put(made)
                        if stack:
                            stack[-1][3] = False
                        stack.append([indent, made, None, False])
                    elif indent != top[0] or not isinstance(top[1], kind):
                        raise Invalid("indentation")
                    elif top[3]:
                        put(None)
                    stack[-1][3] = True
                    if m:
                        key = m.group(1)
                        key = quoted(key, 0)[0] if key[0] in "\"'" else key.strip()
                        if key in stack[-1][1] and key == "<<":
                            raise Invalid("merge")
                        stack[-1][2] = key
                        rest = body[m.end() :]
                    else:
                        rest = body[1:]
                    inner = rest.lstrip(" ")
                    value = _uncommented(inner)
                    if not value:
                        self.at += 1
                        break
                    if dash:
                        indent, body = indent + 1 + len(rest) - len(inner), inner
                        if inner == "-" or inner.startswith("- ") or _KEY.match(inner):
                            continue
                    put(self._value(value, stack[-1][0]))
                    stack[-1][3] = False
                    break
                if root is not None or stack:
                    raise Invalid("text without a key")
                root = self._value(_uncommented(body), -1)
                break
        while stack:
            self._close(stack)
        return root

    def _close(self, stack: list) -> None:
        indent, held, key, open_ = stack.pop()
        if open_:
            if isinstance(held, list):
                held.append(None)
            else:
                held[key] = None

    def _value(self, text: str, indent: int):
        """The value that starts on this line, with the lines that it goes on for."""
        self.at += 1
        if text[0] in "|>":
            return self._block(text, indent)
        if text[0] in "&*!%@`":
            raise Invalid("indicator")
        if text[0] in "[{\"'":
            last = self.at  # it goes on in deeper and in empty lines
            while last < len(self.lines) and (not self.lines[last].strip() or len(self.lines[last]) - len(self.lines[last].lstrip(" ")) > max(indent, 0) or indent < 0):
                last += 1
            text = "\n".join([text, *self.lines[self.at : last]])
            value, end = quoted(text, 0) if text[0] in "\"'" else flow(text)
            line = text.find("\n", end)
            if _uncommented(" " + text[end : line if line >= 0 else len(text)].strip()).strip():
                raise Invalid("text after a value")
            self.at += text.count("\n", 0, end)
            return value
        while self.at < len(self.lines):  # a plain scalar goes on in deeper lines
            line = self.lines[self.at]
            body = line.strip()
            if not body or len(line) - len(line.lstrip(" ")) <= max(indent, 0) or body.startswith("#"):
                break
            if _KEY.match(body):
                raise Invalid("key in a scalar")
            text += " " + _uncommented(body)
            self.at += 1
        if re.search(r":(\s|$)", text):
            raise Invalid("key in a scalar")
        return scalar(text)

    def _block(self, head: str, indent: int) -> str:
        if not re.fullmatch(r"[|>][-+]?", head):
            raise Invalid("block")
        taken: list[str] = []
        depth = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body and len(line) - len(body) <= max(indent, -1):
                break
            if body and depth is None:
                depth = len(line) - len(body)
            if body and len(line) - len(body) < depth:
                raise Invalid("block")
            taken.append(line[depth or 0 :] if body else "")
            self.at += 1
        kept = len(taken)
        while kept and not taken[kept - 1]:
            kept -= 1
        body, rest = taken[:kept], len(taken) - kept
        if head[0] == "|":
            text = "\n".join(body)
        else:
            text = ""
            for i, line in enumerate(body):
                if not line:
                    text += "\n"
                elif text and not text.endswith("\n") and i:
                    text += " " + line
                else:
                    text += line
        end = head[1:]
        return text + ("" if end == "-" or not body else "\n" * (1 + rest) if end == "+" else "\n")


def load(text: str):
    """The value of a YAML text; Invalid if it isn't one."""
    return _Reader(text.replace("\r\n", "\n")).read()


def metadata(text: str) -> str:
    """A front matter's map as JSON; the empty map if it is invalid, no map, or more than JSON holds."""
    try:
        value = load(text)
        return json.dumps(value if isinstance(value, dict) else {}, ensure_ascii=False, allow_nan=False)
    except (ValueError, OverflowError, RecursionError):
        return "{}"


def split(text: str) -> tuple[str, str]:
    """(metadata as JSON, body): front matter stands between lines of three dashes at the start."""
    if not text.startswith("---\n"):
        return "{}", text
    end = text.find("\n---\n", 3)
    if end < 0:
        return "{}", text
    return metadata(text[4:end] if end > 3 else ""), text[end + 5 :]
