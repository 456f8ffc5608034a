"""Bibliographies and spelt numbers against plain loops."""

import random
import re

from lakequill.operators import references as R
from lakequill.operators import spelt as S

CUES = ["unlike", "in contrast", "whereas", "different from", "differs  from", "対照的"]


def test_region(spark):
    texts = {
        1: "a\nReferences\nx\nAcknowledgements\ny\n 3. R E F E R E N C E S \n[1] p\nq\nAPPENDIX A\nz",
        2: "References ..... 12\nno more",
        3: "Bibliography [1] one\n[2] two",
        4: "",
        5: None,
        6: "■ Literature  Cited ●\nfirst\n\n second\nSupplementaryX\nAppendices",
        7: "References of a kind",
    }
    got = {r.doc_id: (r.body, r.first, r.end, r.region) for r in R.regions(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == ("a\nReferences\nx\nAcknowledgements\ny", 5, 8, " 3. R E F E R E N C E S \n[1] p\nq")
    assert got[2] == (texts[2], None, None, None) and got[7][3] is None
    assert got[3] == ("", 0, 2, texts[3])
    assert got[4] == got[5] == ("", None, None, None)
    assert got[6] == ("", 0, 5, "■ Literature  Cited ●\nfirst\n\n second\nSupplementaryX")
    found = R.regions(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text")
    items = {(r.doc_id, r.pos): (r.number, r.item) for r in R.items(found, "doc_id").collect()}
    assert items[1, 1] == (1, "[1] p\nq") and items[3, 2] == (2, "[2] two") and items[3, 1] == (1, "[1] one\n")
    assert [items[6, i][1] for i in range(4)] == ["■ Literature  Cited ●", "first", " second", "SupplementaryX"]


def test_contrast(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for doc in range(120):
        body = "".join(rng.choice([*CUES, "word ", "longerwords and more ", "\n", " [1]", " [2, 4-6]", "[[3]]", "x", "。", " "]) for _ in range(40))
        docs.append((doc, body))
        for m in re.finditer(r"(?<!\[)\[(1|2, 4-6|3)\]", body):
            near = any(c.start() >= max(0, m.start() - 80) for c in re.finditer(rf"{R.CONTRAST}|対照的", body[: m.start()], re.I))
            for n in {"1": [1], "3": [3], "2, 4-6": [2, 4, 5, 6]}[m[1]]:
                want.setdefault((doc, n), []).append(near)
    got = {}
    for r in R.citations(spark.createDataFrame(docs, "doc_id long, body string"), "doc_id").collect():
        got.setdefault((r.doc_id, r.number), []).append(r.contrast)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {True, False} <= {x for v in want.values() for x in v}


def test_cited_items(spark):
    text = "Unlike this [1], that holds [1, 2]. " + "z" * 90 + " so [2].\nReferences\n[1] A, arXiv:2401.00001v2 and 2401.00001\n[2] B doi.org/10.1000/ABC(1).\n[2] C 2402.00002\n[3] D 10.5281/zenodo.77\n[4] E 2403.00003"
    got = {r.number: (r.cites, r.contrasts, r.idents) for r in R.cited_items(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: (2, 2, ["arxiv:2401.00001"]), 2: (2, 1, ["doi:10.1000/abc(1)"]), 4: (0, 0, ["arxiv:2403.00003"])}


def test_spelt(spark):
    ones = S.SMALL[1:10]
    spell = {n: S.SMALL[n] for n in range(20)} | {10 * (i + 2): t for i, t in enumerate(S.TENS)}
    spell |= {10 * (i + 2) + k + 1: f"{t}{'- '[k % 2]}{o}" for i, t in enumerate(S.TENS) for k, o in enumerate(ones)} | {100 * (k + 1): f"{o} hundred" for k, o in enumerate(ones)}
    rows = [(n, f"About {w.capitalize()}, no more") for n, w in spell.items()]
    rows += [(n * f, f"{w} {s.upper()} of them") for n, w in spell.items() for s, f in S.SCALES.items() if n]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "i int, n long, t string")
    for r in df.select("n", "t", S.spelt_keys("t").alias("k")).collect():
        assert str(r.n) in r.k, (r.t, r.k)
        assert len(r.k) == (2 if r.t.endswith("of them") else 1), (r.t, r.k)
    odd = [("someone tone", []), ("Half a dozen, twice", ["0.5", "12", "2"]), ("half million", ["0.5", "500000"]), ("", []), (None, None), ("first-second", ["1", "2"])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(odd)], "i int, t string").select("i", S.spelt_keys("t").alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: k for i, (_, k) in enumerate(odd)}
