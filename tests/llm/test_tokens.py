import random

from tessella.llm import tokens
from tessella.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
ODD = ["", " ", "  ", " a", "a ", "a  ", "\n a", "a\n b \n c ", "x" * 3000, " " * 900 + "a" * 900, "<|endoftext|>" * 80, "a <|endoftext|>  b\n\n" * 60, "don't 've 's\t" * 80, "é😀 " * 200, "\n".join("ab  c" for _ in range(200))]


def library(text):
    return len(tokens.tokenizer(PATH).encode(text, add_special_tokens=False).ids)


def test_units_spell_the_text_and_count_alike():
    r = random.Random(3)
    for t in ODD + ["".join(r.choice(" \n\ta1. é'<|") for _ in range(30)) for _ in range(500)]:
        assert "".join(tokens.units(t)) == t
        assert tokens.batch_counts([t], PATH) == [library(t)]


def test_chunks_are_spliced_where_both_sides_agree(rows):
    for chunk, overlap in ((100, 4), (300, 16), (1000, 64)):
        for t in ODD + [t[:6000] for _, t in rows if t]:
            assert tokens.count_tokens(t, PATH, chunk, overlap) == library(t)


def test_query(docs, rows, empty):
    got = {r.doc_id: r for r in tokens.token_counts(docs, PATH).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), library(t or ""), library(t or "") > 512)
    assert tokens.token_counts(empty, PATH).count() == 0
