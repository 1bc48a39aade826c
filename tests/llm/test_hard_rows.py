"""Null ids, repeated rows, null, empty and very long texts, an empty table and clashing column names, for every operator."""

import random
from collections import Counter

import pytest
from barlake.llm import fingerprints, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, toxicity
from pyspark.sql import functions as F

NAMES = "key n rep part component component_id n_shingles row codes uid n_bytes kept kept_sha256 cdf draws rate u _u _n _source block name size id d p q score predicted features fingerprint near held bucket".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(150)
    return [(1, base), (1, base), (None, base), (None, base), (2, None), (3, ""), (4, "\n \t"), (5, say(40_000)), (6, say(60)), (7, base + " end"), (None, None), (8, "one"), (9, "漢字 🙂 " * 300)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s" if (i or 0) % 2 else None) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(NAMES)))


def count(df, c="doc_id"):
    return Counter(r[c] for r in df.select(c).collect())


@pytest.fixture(scope="module")
def ids(texts):
    return Counter(i for i, _ in texts)


def test_join(docs, ids, texts):
    got = ngram_join.join_components(docs).collect()
    assert Counter(r["doc_id"] for r in got) == ids
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[7] == of[1] == 1 and of[None] is None and all(of[i] == i for i in (2, 3, 4, 5, 6, 8, 9))
    assert ngram_join.join_components(docs.limit(0)).count() == 0


def test_join_of_an_id_with_several_texts(spark, texts):
    """One document: its texts link it to the partners of each."""
    base, other = texts[0][1], texts[8][1]
    rows = [(1, base), (2, other), (3, base + " more"), (3, other + " more")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    """Chains of near copies, with groups cut far smaller than they are, against brute force."""
    monkeypatch.setattr(ngram_join, "CELL", 8)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    rng = random.Random(2)
    rows, now = [], [str(rng.random()) for _ in range(60)]
    for i in range(70):
        if rng.random() < 0.9:
            now = now[:]
            now[rng.randrange(60)] = str(rng.random())
        rows.append((i, " ".join(now)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least


def test_repeats(docs, ids, spark):
    out = suffix_dedup.remove_repeats(docs, 64)
    assert count(out) == ids and {r["uid"] for r in out.select("uid").collect()} == {NAMES.index("uid")}
    assert {r["n_removed"] > 0 for r in out.where("doc_id = 1 or doc_id = 7").collect()} == {True}
    assert suffix_dedup.remove_repeats(docs.limit(0), 64).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("barlake_texts")]


def test_scoring(docs, ids):
    model = lm_scoring.fit(docs.where("doc_id > 4").select("text"))
    got = lm_scoring.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == ids and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm_scoring.score(docs.limit(0), model).count() == 0


def test_rules(docs, ids):
    got = quality_rules.clean_lines(docs).collect()
    assert Counter(r["doc_id"] for r in got) == ids and not any(r["kept"] for r in got if r["doc_id"] in (2, 3, 4))
    assert quality_rules.clean_lines(docs.limit(0)).count() == 0


def test_rules_of_lines(spark):
    """Which lines go, and when a document goes with them."""
    prose = "This is a line of plain prose that says a few things and ends as it should."
    bad = ["Home", "About us", "Contact", "| a | b | c |", "see http://a.b http://c.d now", "read on and on ...", "All Rights Reserved by us.", "### $$$ &&& ***", "Wow!! Look!! Now!!"]
    more = "Another one follows, which shares nothing with the first; it is as long and is to be kept."
    rows = [(1, "\n".join([prose, *bad, more, "Short title"])), (2, "\n".join([prose, *bad, *bad, *bad])), (3, "\n".join([prose, "Short title", "Other title", more]))]
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["cleaned"] == "\n".join([prose, more, "Short title"]) and got[1]["n_bad_lines"] == len(bad) and not got[1]["base_failed"]
    assert got[3]["n_bad_lines"] == 0 and got[3]["kept"] and not got[2]["kept"]


def test_rules_work_steps_out_once(docs, spark):
    """What several steps use isn't worked out in each of them, and windows are counted in texts of few and of equal words."""
    plan = quality_rules.clean_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 2 and plan.count("lower(_text") == 1
    texts = [" ".join("a" * n) for n in range(12)] + ["a b c d e\ta  b\nc d e", "a b c d e b c d e a", "a b c d e f a b c d e g b c d e f", "ab c d e f a bc d e f", "a b b a c b a a b c"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        assert got[i] == len({k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)})


def test_versions(docs, ids):
    out = fingerprints.compare_versions(docs.withColumn("edited", F.concat(F.coalesce("text", F.lit("")), F.lit("\nx"))), "text", {"edited": "edited"})
    assert count(out) == ids and {r["id"] for r in out.select("id").collect()} == {NAMES.index("id")}
    after = fingerprints.next_documents(docs)
    assert count(after) == ids
    assert fingerprints.compare_versions(docs.limit(0), "text", {"again": "source"}).count() == 0


def test_learned_scores(docs, ids, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (6, 1, 0), (8, 0, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for fit, score in ((toxicity.fit, toxicity.score_toxicity), (quality_classifier.fit, quality_classifier.score_quality)):
        for some in (labels, labels.limit(0)):
            got = score(docs, fit(docs, some)).collect()
            assert Counter(r["doc_id"] for r in got) == ids and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_mixing_keeps_every_column(docs, ids):
    out = mixing.mix_sources(docs, epochs=4.0)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    assert {tuple(r) for r in out.select(*NAMES).collect()} == {tuple(range(len(NAMES)))}
    n = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
    assert n[(1, docs.where("doc_id = 1").first()["text"])] % 2 == 0  # equal rows are drawn alike


def test_a_source_of_ten_characters(spark):
    rows = [(0, "abcdefghij", "tiny")] + [(i, "x" * 200_000, "big") for i in range(1, 5)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"tiny": 1.0, "big": 1.0})
    n = Counter(r["source"] for r in out.select("source").collect())
    assert abs(n["tiny"] - 40_000) < 1500


def test_packing_rows(docs, ids):
    P = pytest.importorskip("public_tokenizers")
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = Counter()
    for r in out.select("doc_id", "start", "length").collect():
        got[r["doc_id"]] += r["start"] == 0
    assert got == ids and packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_disguises_of_any_length(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i * 7919:07d}")
    rows = [(i, f"plain words {name(i)} and more of them here {name(i + 100)} plain " + ("idiot" if i % 2 else ""), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    odd = ".".join(["plain"[0]] + list("lain" + "idiot" * 40))  # some 400 characters in one token
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame([(1, odd), (2, "plain words here"), (3, " ".join("idiot" * 30))], "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_chat_with_long_texts_and_clashing_names(spark, texts):
    from barlake.llm import chat

    long = "a<b>[INST] </s>" * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", None), (2, 1, None, ""), (None, 0, "user", "no id"), (1, 1, "assistant", long)]
    said = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    said = said.select("*", *(F.lit(k).alias(c) for k, c in enumerate([*NAMES, "tree", "node", "parent", "leaf", "up", "formatted", "_t", "_n", "to", "loss_spans"])))
    done = chat.format_branches(chat.chain_tree(said))
    got = {r["tree"]: r for r in done.select("tree", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [t["text"] for t in got[1]["t"]] == [long, long, long] or [t["text"] for t in got[1]["t"]].count(long) == 3
    assert got[1]["l"] == long * 2 and [t["text"] for t in got[2]["t"]] == ["", ""] and got[None]["t"][0]["text"] == "no id"


@pytest.fixture
def folder(spark, texts, tmp_path):
    def write(rows, labels):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(NAMES) if c not in docs.columns)).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_hard_rows(spark, texts, folder):
    """Nulls in every column, repeated rows, clashing names: no stage fails, and what is packed came in."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, None if k % 3 else "en", "s" if k % 2 else None, len(t) if t else None) for k, (i, t) in enumerate(texts)]
    labels = [(i, int(i not in (2, 3, 4)), 0) for i, _ in texts if i is not None] + [(None, 1, None)]
    out = pipeline.run(spark, folder(rows, labels)).collect()
    assert {r["doc_id"] for r in out} <= {i for i, _ in texts}
    for i in {r["doc_id"] for r in out} - {None}:
        pieces = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == i)
        assert all(n & (n - 1) == 0 for _, n in pieces)


def test_pipeline_on_empty_tables(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, folder([], [])).count() == 0
