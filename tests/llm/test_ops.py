"""The ten operators against brute force, on small inputs with nulls, ties, repeats, empty and long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakequill.llm import bpe_codec, line_dedup, media, ngram_join, packing, perspectives, pivot_search, sharding, token_counts, toxicity
from lakequill.llm.bpe import RankBPE
from lakequill.llm.common import connected_components
from lakequill.llm.shingles import shingle_sets

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, shard int, line string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(30)]
    near = [re.sub(r"w1\b", "z", t) for t in base[:10]]
    return [None, "", " \n\t ", "one two", "One  TWO", "x" * 5000 + " y", "é日本 <|endoftext|> don't\n\nΣΑΣ", *base, *near, *base[:5], " ".join(r.choices(words, k=6000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, empty, texts):
    out = {r["doc_id"]: r for r in media.digest(media.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["media_bytes"] == 1078 + len(padded)
    assert media.digest(media.store_texts(empty)).count() == 0


def test_media_carving(spark):
    bmp = media.as_bitmap(b"BM RIFF %PDF- " + b" " * 178)
    png = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", bytes(13)), (b"IDAT", b"x"), (b"IEND", b"")):
        png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    wav = b"RIFF" + (4 + 8 + 4).to_bytes(4, "little") + b"WAVE" + b"data" + (4).to_bytes(4, "little") + b"abcd"
    assert media.sniff(b"junk BM RIFF" + png + b"--" + wav + bmp) == [(12, len(png), "image/png"), (14 + len(png), len(wav), "audio/wav"), (14 + len(png) + len(wav), len(bmp), "image/bmp")]
    assert media.sniff(png[:-1]) == [] and media.sniff(b"") == []
    df = spark.createDataFrame([(1, bytearray(png), "image/gif"), (2, None, None), (3, bytearray(b"BM"), "image/bmp")], "doc_id long, media binary, declared string")
    got = {r["doc_id"]: (r["type"], r["corrected"], len(r["found"])) for r in media.sniffed(df).collect()}
    assert got == {1: ("image/png", True, 1), 2: (media.UNKNOWN, True, 0), 3: (media.UNKNOWN, True, 0)}


def test_line_dedup(spark, empty):
    long = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    rows = [(1, f"{long}\n\nshort", "a"), (2, f"{long}\nother line of text here", "a"), (3, f"{long[:-4]}wool\nshort", "a"), (4, None, "a"), (5, "", "a"), (6, f"{long}", "a"), (None, long, "a"), (7, "tail\n" * 3, "a")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, line string")).collect()}
    assert got == {1: f"{long}\n\nshort", 2: "other line of text here", 3: "", 4: None, 5: "", 6: "", None: long, 7: "tail\n"}
    assert line_dedup.dedup(empty.select("doc_id", "text")).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_ngram_join(docs, empty, texts):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert got == set(brute_components(texts))
    assert ngram_join.components(empty).count() == 0


def test_prefix_bound():
    for n in range(1, 400):
        p = ngram_join.prefix_size(n)
        assert n - p == (3 * n + 3) // 4 - 1 and 4 * (n - p) < 3 * n


def test_shingles_of_long_text_are_the_same_in_pieces():
    t = "alpha beta gamma delta epsilon zeta " * 90_000
    (whole,) = shingle_sets([t])
    assert len(whole) == 6


def test_sharding(docs, empty, texts):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert len(rows) == len(texts) + 1 and all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    order = [r["doc_id"] for k in sorted(by) for r in sorted(by[k], key=lambda r: r["slot"])]
    assert order == sorted(order) and sharding.shard_by_bytes(empty).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "s"), (None, 0, "a", "t"), (None, 1, "b", "u")]
    out = perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["position"]):
        by.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    assert set(by) == {(1, "user"), (1, "bob"), (None, "a"), (None, "b")}
    for rs in by.values():
        whole = "".join(r["piece"] for r in rs)
        for r in rs:
            assert whole[r["start"] : r["start"] + len(r["piece"])] == r["piece"]
            assert (r["mask_end"] > r["mask_start"]) == r["learn"] == (r["name"] == r["speaker"])
    assert [r["piece"] for r in by[1, "bob"]] == ["<|system|>\nrules<|end|>\n", "<|user|> user:\nhi<|end|>\n", *["<|assistant|>\n<|end|>\n"] * 2, "<|user|> user:\nx<|end|>\n"]


def test_toxicity(spark, empty):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        ws, bad = r.choices(words, k=30), i % 3 == 0
        if bad:
            ws[r.randrange(30)] = r.choice(["scoundrel", "villain", "rascal"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad), 1))
    rows += [(1000, None), (1001, ""), (1002, "you v.i.l.l.a.i.n go"), (1003, "s c o u n d r e l")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, lab)
    out = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, x in out.items() if x["held_out"] and i < 400} == set(held)
    assert sum(out[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert out[1002]["predicted"] == out[1003]["predicted"] == 1 and out[1000]["predicted"] == out[1001]["predicted"] == 0 and out[1000]["score"] == out[1001]["score"]
    assert toxicity.score(empty, model).count() == 0 and toxicity.without_toxic(docs, model).columns == docs.columns
    none = toxicity.train(docs, lab.where("toxic = 0"))
    assert {x["score"] for x in toxicity.score(docs, none).collect()} == {0.0}


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_token_counts(docs, empty, texts, block):
    lib = Tokenizer.from_file(WORD)
    lib.encode_special_tokens = True
    blocks = token_counts.token_files(docs, WORD, 49407, block)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.document_counts(blocks, 49407).collect())
    want = [(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert got == sorted([*want, want[8]])
    assert token_counts.document_counts(token_counts.token_files(empty, WORD, 49407), 49407).count() == 0


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 9, 1, 9, 9, 7, 7, 7, 7, 7, 7, 9, 3], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    for block in (1, 2, 3, 100):
        got = sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in token_counts.document_counts(token_counts.read_token_files(spark, str(tmp_path), block), 9).collect())
        assert got == [(0, 1, True), (1, 1, True), (2, 0, True), (3, 6, True), (4, 1, False)]


def test_packing(docs, empty, texts):
    lib = Tokenizer.from_file(WORD)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(docs, WORD, 1, 512).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(by_doc[i] == len(x) * (2 if i == 8 else 1) for i, x in ids.items())
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 512
    assert packing.pack(empty, WORD).count() == 0


def test_level_packer_is_the_least_square_rule():
    r, p, n = random.Random(1), packing.LevelPacker(40), [0] * 41
    for _ in range(600):
        size = r.randint(1, 40)

        def grown(level, size=size):
            m = list(n)
            if level:
                m[level] -= 1
            if level + size < 40:
                m[level + size] += 1
            return sum(x * x for x in m)

        options = [h for h in range(41 - size) if h == 0 or n[h]]
        _, at = p.place(size)
        assert grown(at) == min(map(grown, options))
        if at:
            n[at] -= 1
        if at + size < 40:
            n[at + size] += 1


def test_pivot_search(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(size=(150, 8)), np.tile(r.normal(size=8), (50, 1))]).astype("float32")
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0]), (100, [float(x) for x in v[100]])]
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).collect()]
    q = np.floor(v.astype(float) * 1024).astype(int)
    want = []
    ids = [*range(200), 100]  # the second row with id 100 is a candidate and a query of its own
    for i in (0, 100):
        best = sorted((-int(q[i] @ q[j]), j) for j in ids for _ in range(ids.count(i)) if j != i)[:10]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert pivot_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0


def test_bpe(docs, empty, texts):
    lib = Tokenizer.from_file(BYTE)
    out = {r["doc_id"]: r for r in bpe_codec.map_codec(docs, BYTE, bpe_codec.digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (out[i]["n_tokens"], out[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert out[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe_codec.decode(bpe_codec.encode(docs, BYTE), BYTE).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts)) and bpe_codec.encode(empty, BYTE).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_odd_texts(path):
    r, lib, mine = random.Random(9), Tokenizer.from_file(path), RankBPE(path)
    odd = ["".join(r.choice("ab cdE\n\t'stlm.,!01éÑß ́\x1c\x85\xa0　Σς½日😀<|>") for _ in range(r.randint(0, 60))) for _ in range(500)] + ["ab" * 400, "'S 'll 'tis !'s"]
    assert [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(odd, add_special_tokens=False)] == list(mine.encode_many(odd))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: x for n, x in root.items() if n in {m for e in edges if e[0] != e[1] for m in e}}
    assert F is not None


def test_pivot_search_keeps_rows_with_one_id_like_its_sql(spark, tmp_path):
    import duckdb

    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (1, [0.9, 0.2]), (2, [0.3, 0.3]), (100, [0.2, -0.4]), (100, [-0.7, 0.4])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    expected = [(int(q), int(s)) for q, _, _, s in con.execute(pivot_search.ORACLE).fetchall()]
    got = [(r["query_id"], r["score"]) for r in pivot_search.top_k(vectors, lambda i: i % 100 == 0).collect()]
    assert sorted(got) == sorted(expected)
    assert (0, 921 * 1024) in got


def test_byte_law_of_shards(spark, docs, texts):
    size = lambda t: len((t or "").encode()) + 1
    rows = [(i, size(t)) for i, t in enumerate(texts)] + [(8, size(texts[8]))]
    rows.sort()
    total, before, expected = sum(s for _, s in rows), 0, []
    for i, s in rows:
        expected.append((i, s, min(15, (2 * before + s) * 16 // (2 * total))))
        before += s
    got = [(r["doc_id"], r["size"], r["shard"]) for r in sharding.shard_by_bytes(docs, 16).collect()]
    assert sorted(got) == sorted(expected)
    few = sharding.shard_by_bytes(docs.where("doc_id < 3"), 16)
    assert few.count() == 3 and few.where("slot <> 0").count() == 3 - few.select("shard").distinct().count()


def test_toxicity_does_not_cut_spaced_letters(monkeypatch):
    weights = np.random.default_rng(1).normal(size=toxicity._LETTERS**3)
    monkeypatch.setattr(toxicity, "_CHUNK", 512)
    for shift in range(0, 24, 3):
        text = "plain words " * 41 + "x" * shift + " i d i o t " + "plain words " * 60
        code, word, owner = toxicity.flatten([text])
        whole = toxicity.word_scores(code, word, len(owner), weights).max()
        assert toxicity.document_values([text], weights)[0] == pytest.approx(whole)


def test_word_scores_against_a_kernel_by_brute_force():
    from itertools import combinations

    weights = np.random.default_rng(2).normal(size=toxicity._LETTERS**3)
    for w in ("idiot", "a", "i.d.i.o.t", "abababab"):
        code, word, _ = toxicity.flatten([w])
        total = norm = 0.0
        for i, j, k in combinations(range(len(code)), 3):
            if k - i < toxicity.SPAN:
                weight = toxicity.DECAY ** (k - i)
                total += weight * weights[(int(code[i]) * toxicity._LETTERS + int(code[j])) * toxicity._LETTERS + int(code[k])]
                norm += weight * weight
        assert toxicity.word_scores(code, word, 1, weights)[0] == pytest.approx(total / max(norm, 1e-12) ** 0.5)


def test_ngram_join_with_null_and_repeated_ids(spark):
    same, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, same), (None, same), (None, "only here and nowhere else at all"), (7, other), (7, same), (9, other + " b40"), (None, None)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 36, 5), (None, 36, 5), (None, 3, None), (7, 36, 5), (9, 37, 5), (None, 0, None)}


def test_toxicity_learns_from_sentences(spark):
    assert toxicity.sentences("Bad one here. Good\nv i l e X") == [["bad", "here", "one"], ["good"], ["vilex"]]
    assert toxicity.sentences("Bad one. x. " + "y" * (toxicity.LONGEST + 1)) == [["bad", "one"]] and toxicity.sentences("") == []
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(600):
        cut = [r.choices(words, k=6) for _ in range(12)]
        if i % 4 == 0:
            # each insult in few of the toxic documents
            cut[r.randrange(12)][2] = ["scoundrel", "villain", "rascal", "knucklehead", "poltroon"][i // 4 % 5]
        rows.append((i, ". ".join(map(" ".join, cut))))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "the poltxroon is here. aa bb"), (1001, "the rasical. aa bb"), (1002, ". ".join(words[:5]))]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    twice = docs.unionByName(docs.where("doc_id < 40"))
    model = toxicity.train(twice, lab)
    out = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert out[1000]["predicted"] == out[1001]["predicted"] == 1 and out[1002]["predicted"] == 0
