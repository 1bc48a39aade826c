"""The registered queries on the smallest tables: by SQL where there is one, else by brute force on their contracts."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from barlake.llm import queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


def rows(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got)
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)


def test_op1(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    got, ends = {}, Counter()
    for r in rows(spark, "op1_packing"):
        got.setdefault(r["doc_id"], []).append(r)
        ends[r["sequence_id"]] += r["length"]
    assert got.keys() == texts.keys() and max(ends.values()) <= 2048
    for i, t in texts.items():
        ids, at = np.array([*exact.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)


def test_op2(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op2_ngram_join")}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()} and any(i != c for i, (_, c) in got.items())


def test_op3(spark, texts):
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[k : k + 400] for b in data.values() for k in range(len(b) - 399))
    for r in rows(spark, "op3_suffix_dedup"):
        b = data[r["doc_id"]]
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = 1
        kept = np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op4(spark, texts):
    words = {i: WORD.findall(t.translate(LOWER)) + ["</>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows(spark, "op4_lm_scoring"):
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0


def test_op7(spark, texts):
    ids = sorted(texts)
    piece = lambda t: set(re.findall(r"[^\n]{1,240}", t))
    near = lambda a, b: len(piece(a) & piece(b)) / len(piece(a) | piece(b)) if piece(a) | piece(b) else 1.0
    got = {r["doc_id"]: r for r in rows(spark, "op7_fingerprints")}
    prints = {}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        part = len(t) // 4
        edited = t[: len(t) - part] + after[:part]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(t, edited)) and r["near_next"] == pytest.approx(near(t, after))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and (edited != t or r["fingerprint"] == r["edited_fingerprint"])


@pytest.mark.parametrize("name, threshold, label", [("op8_toxicity", 0.5, "toxic"), ("op10_quality_classifier", 0.3, "quality")])
def test_classifiers(spark, name, threshold, label):
    """Accuracy over the held-out labelled rows alone, of a larger table."""
    sf = SF.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}
    assert got.keys() == {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{sf}/documents.parquet'").fetchall()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    held = [(i, y) for i, y in duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall() if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([got[i]["predicted"] == y for i, y in held]) > 0.9


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_pipeline(spark, texts):
    """Each stage against its predecessor's rows, by brute force."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from barlake.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) <= set(ids[1]) and ids[3] == ids[2] and set(ids[4]) <= set(ids[3])
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) > 0
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in kept[1].select("doc_id", "text").collect()}
    left = set(ids[2])
    assert not any(near(sets[a], sets[b]) for a in left for b in left if a < b)
    for gone in set(sets) - left:  # each that went has a chain of near copies to one that stayed
        reached, front = {gone}, [gone]
        while front and not reached & left:
            now = front.pop()
            new = [b for b in sets if b not in reached and near(sets[now], sets[b])]
            reached.update(new)
            front += new
        assert reached & left
    cut = {r["doc_id"]: r["text"] for r in kept[3].select("doc_id", "text").collect()}
    long = Counter(t[k : k + 400] for t in cut.values() if t.isascii() for k in range(len(t) - 399))
    assert max(long.values(), default=1) == 1
    pieces = pipeline.run(spark, SF).toPandas()
    assert Counter(pieces["doc_id"]).keys() == ids[4].keys() and (pieces["length"] & (pieces["length"] - 1) == 0).all()
