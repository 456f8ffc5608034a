"""Alignment of whole texts, by the two libraries and plain loops, against segments aligned once."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from lakequill.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a▁b", "x\x00y", "<s>a</s> <|endoftext|> <0x41> <unk>", "  a \n\n b\tc\r\n d;\r e   f  g 　\n", "\n\nq", "\t", "漢字 かな" * 50, "a" * 5000, "\x1c \x1cz! \x1c",
    "it's we'll 'tis", "x    y   z", "👩‍👩‍👧 naïve ﬁ Ａ", "a\r b\r\r\n c", "word " * 4000,
]


def _brute(rows):
    two = T.pair(A, B)
    counts, full = Counter(), []
    for key, text in rows:
        x, y = [], []
        if text:
            whole = " " + text
            x, y = two.a.encode(whole, add_special_tokens=False).ids, two.b.encode(text)
            if b"".join(two.a_bytes[i] for i in x) != whole.encode() or b"".join(two.b_bytes[i] for i in y) != whole.encode():
                x = y = []
        ends = []
        for ids, size in ((x, two.a_length), (y, two.b_length)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + int(size[i])))
                at = spans[-1][1]
            ends.append(spans)
        links, j = [], 0
        for (lo, hi), a in zip(ends[0], x, strict=True):
            while ends[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(y) and ends[1][k][0] < hi:
                links.append((a, y[k]))
                k += 1
        groups, i, j = [], 0, 0
        for e in sorted({e for _, e in ends[0]} & {e for _, e in ends[1]}):
            ga, gb = [], []
            while i < len(x) and ends[0][i][1] <= e:
                ga.append(str(x[i]))
                i += 1
            while j < len(y) and ends[1][j][1] <= e:
                gb.append(str(y[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        counts.update(links)
        full.append((key, len(x), len(y), links, groups))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for key, n, m, links, groups in full:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n else ""
        out.append((key, n, m, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [300, 16_000_000])
def test_against_whole_texts(spark, chars):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefé,.;'") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows = [(i, rng.choice(["", " ", "\n"]).join([""]) + "".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", ", "]) for w in rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [rows[3], (None, "no id here")]
    docs = spark.createDataFrame([(k, t, "b", 1, "s") for k, t in rows], "doc_id long, text string, block string, place int, segment string")
    got = T.align_documents(docs.repartition(3), A, B, chars=chars)
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_groups_themselves_and_empty(spark):
    schema = "doc_id long, text string"
    got = T.align_documents(spark.createDataFrame([(1, "Hello wörld"), (2, None)], schema), A, B, digest=False).collect()
    by = {r.doc_id: r for r in got}
    assert by[2].groups == "" and by[2].n_links == 0
    assert by[1].groups.count(";") + 1 == by[1].n_groups and by[1].n_links == by[1].n_a + by[1].n_b - by[1].n_groups
    assert T.align_documents(spark.createDataFrame([], schema), A, B).count() == 0


def test_cuts_are_where_no_piece_goes_across():
    two = T.pair(A, B)
    assert two.split(" a b\n c;\r d\u00a0 e") == [" a", " b", "\n c;\r d\u00a0 e"]
    assert two.split(" c;\rx") == [" c;\rx"]  # some pieces hold a return behind a sign
    assert two.split("x   y") == ["x   y"]  # white space of another kind before the cut would join in the first tokenizer
