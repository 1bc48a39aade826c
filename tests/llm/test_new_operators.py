"""Filter audit, vector codes and token counts: against brute force, on hard rows and on rows of which a third is one group."""

import itertools
import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from barlake.llm import filter_audit, token_counts, vector_codes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


# ---- filter audit


def brute_audit(rows, labels):
    """Filters run one after the other over the documents, as the contract says it."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))  # no id, no label
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and t in least and least[t] < i,
        }
        docs.append((source or "", i, frozenset(k for k in fails if fails[k])))
    out = {}
    for part in {d[0] for d in docs}:
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[2]], [d for d in left if f not in d[2]]
                redundant = sum(f in d[2] and bool(d[2] & set(order[: step - 1])) for d in docs if d[0] == part)
                unique = sum(d[2] == {f} for d in docs if d[0] == part)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)]
                total[f] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def audit_rows():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "x" * rng.randint(1, 60), "#tag", "漢字"]) for _ in range(n))
    rows = [(i, say(rng.choice([0, 1, 30, 49, 50, 80])), rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(1000 + i, rows[7][1], "a") for i in range(700)]  # one text in most rows: several salts
    rows += [(None, rows[7][1], "b"), (None, None, None), (5, "same id", "a"), (5, "same id", "a"), (5, rows[9][1], "a"), (2, None, "b"), (3, "", "b"), (4, "\n\t ", None)]
    rows += [(6000, "WORD " * 40_000, "b"), (6001, "a\x1fb ÄÖÜ", "a")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1200, 2)] + [(1001, None, None), (None, 1, 1), (1002, 0, 1), (1002, 1, 0)]
    return rows, [(i, q, int(t) if t is not None else None) for i, q, t in labels]


def test_audit_equals_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("part", "bits", "hash", "n", "least", "salt", "good")))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit_filters(docs, marks).collect()}
    assert got == brute_audit(rows, labels) and len(got) == 3 * 600
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    unlabelled = filter_audit.audit_filters(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


def test_copies_are_dealt_by_a_salt(spark):
    """Each task of the semi-join gets COPIES of a hot text at about most, and the shuffle of hashes is of texts that repeat alone."""
    rows, _ = audit_rows()
    docs = spark.createDataFrame([(i, t or "", s) for i, t, s in rows], "doc_id long, text string, part string")
    found = filter_audit.identical_to_earlier(docs, docs.select(F.xxhash64("text").alias("hash")))
    assert found.where("doc_id >= 1000 and doc_id < 2000").count() == 700
    assert found.where("doc_id is null").count() == 0


# ---- vector codes


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    kept = sorted(((i, l, [math.floor(256 * x) for x in v]) for i, v, l in vectors if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes) if k[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    codes = assign()
    error = [sum(dist(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    by = Counter()
    for (_, label, _), e in zip(kept, error):
        by[label] += e
    digest = sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, bytes(k).hex(), e, by[label], digest) for (i, label, _), k, e in zip(kept, codes, error))


def coded(df):
    return Counter((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def vector_rows(n, width=32, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-0.6, 0.6) for _ in range(width)] for _ in range(25)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in rng.choice(middles)], rng.choice([0, 1, None])) for i in range(n)]
    return rows + [(n + i, rows[3][1], 2) for i in range(n // 2)]  # a third is one vector


def test_codes_equal_brute_force(spark):
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in vector_rows(200)]
    for i in range(10):  # seeds that are equal: ties go to the lower number
        rows[i + 10] = (i + 10, rows[i][1], rows[i + 10][2])
    rows += [(-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-4, [float("inf")] + [0.0] * 31, 0), (-5, [1.0] * 31, 0), (-6, [], 0), (None, [0.25] * 32, 0), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    df = df.select("*", *(F.lit(1).alias(c) for c in ("code", "x", "v", "_n", "error", "slot", "_label")))
    want = brute_codes([r for r in rows if r[1] is not None and len(r[1]) == 32])
    assert coded(vector_codes.compress(df)) == want


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in vector_rows(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert coded(vector_codes.compress(df)) == brute_codes(rows)
    assert vector_codes.compress(df.limit(0)).count() == 0 and vector_codes.compress(df.where("vec_id < 0")).columns == vector_codes.compress(df).columns


def test_balls_skip_work(spark):
    """Later rounds work out far fewer distances than all entries have."""
    rows = vector_rows(3000, 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_codes.compress(df).agg(F.count("*"), F.sum("looked")).first()
    assert got[0] == 4500 and got[1] < 0.35 * 4500 * 16 * 64


def test_a_component_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [2.0**21] * 16, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="1048576"):
        vector_codes.compress(df).collect()


# ---- token counts


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def counted(df, chunk, overlap):
    return Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, PATH, chunk, overlap).collect())


def hard_texts():
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzÄß漢") for _ in range(rng.randint(1, 9))) for _ in range(n))
    return [
        None, "", " ", "\n\t ", "plain words here", "a  b   c\n\n\nd ", say(2000), say(300) + "<|endoftext|>" + say(300), "<|endoftext|>" * 400,
        "a" * 5000, "ab" * 3001, " " * 4000, "\n" * 3000 + "x", "漢字仮名" * 900, "🙂" * 1500, "🙂👍🏽" * 700, "'s" * 2000, "'ll've" * 900, "don't " * 800, "!?" * 2500,
        "x" + " " * 999 + "y" * 999 + " \n" * 999, "".join(chr(rng.choice([97, 32, 10, 39, 46, 0x4E00, 0x1F600, 0x301, 0xA0])) for _ in range(6000)), "1234567890" * 600, "́" * 2000,
    ]


def test_counts_equal_the_library(spark, exact):
    texts = hard_texts()
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(6, texts[6])] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("*", *(F.lit(1).alias(c) for c in ("uid", "n_bytes", "n_tokens", "no", "junction")))
    want = Counter((i, len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for chunk, overlap in ((1 << 15, 256), (400, 32), (64, 8)):
        assert counted(df, chunk, overlap) == want
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_failed_alignment_widens_the_overlap(spark, exact, monkeypatch):
    """Neighbours without a token in common are cut again, wider, until they have one or the text is whole."""
    cuts = []
    cut = token_counts.cut
    monkeypatch.setattr(token_counts, "cut", lambda texts, chunk, overlap: cuts.append((chunk, overlap)) or cut(texts, chunk, overlap))
    text = "a" * 1003
    df = spark.createDataFrame([(1, text), (2, "some words " * 50)], "doc_id long, text string")
    assert counted(df, 66, 1) == Counter((i, len(t), len(exact.encode(t, add_special_tokens=False).ids)) for i, t in ((1, text), (2, "some words " * 50)))
    assert len(cuts) > 1 and cuts[1] == (66, 8)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab's tlve \n\n  19!?<|endoftext|>漢🙂é", min_size=30, max_size=400), st.sampled_from([4, 8, 16]))
def test_splices_are_right_or_refused(text, overlap):
    """Any two neighbouring chunks: a splice, if there is one, gives the whole text's number of tokens."""
    encode = token_counts.counter(PATH)
    middle = len(text) // 2
    left, right = text[: middle + overlap], text[max(0, middle - overlap) :]
    (at_a, ids_a), (at_b, ids_b) = encode.places([left, right])
    place = lambda at, m: np.where(at >= 0, at - m, -(1 << 30))
    got = token_counts.splice((0, place(at_a, middle), ids_a), (0, place(at_b, min(middle, overlap)), ids_b))
    if got is not None:
        assert got + len(ids_b) == encode.whole(text)
