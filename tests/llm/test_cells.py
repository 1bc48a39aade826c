"""The cells to which the n-gram join deals a large group."""

import random

import pytest
from barlake.llm import ngram_join
from pyspark.sql import functions as F

ROWS = "g string, blocks int, role byte, skip boolean, n int, key long, rep long, bits binary"
LABEL = "node long, component long"


def test_every_member_meets_all_that_probe(spark, monkeypatch):
    """Random groups, some with a large part, some where all or none skip."""
    monkeypatch.setattr(ngram_join, "CELL", 5)
    rng = random.Random(3)
    rows, label = [], []
    for g, (size, probing, one_part) in enumerate([(60, 0.1, 0.0), (60, 1.0, 0.7), (40, 0.0, 0.5), (33, 0.5, 0.9), (4, 0.5, 0.0), (3, 0.0, 0.0), (50, 0.3, 1.0)]):
        for i in range(size):
            rep = 1000 * g + i
            skip = rng.random() >= probing
            blocks = 2 if size > 5 else 1
            for role in {0: (0,), 1: (1,), 2: (0, 1)}[rng.randrange(3)]:
                rows.append((f"{g}:{g}", blocks, role, skip, 100, rep, rep, b"\x00" * 8))
            if rng.random() < one_part:
                label.append((rep, 1000 * g))
    part = dict(label)
    wanted = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] == 0 and not b[3] and part.get(a[6], a[6]) != part.get(b[6], b[6]):
                wanted.add((a[6], b[6]))
    cells = ngram_join.meeting_cells(spark.createDataFrame(rows, ROWS), spark.createDataFrame(label, LABEL)).collect()
    met = set()
    for c in cells:
        assert len(c["members"]) <= 60
        for a in c["members"]:
            for b in c["members"]:
                if a["role"] == 0 and not b["skip"] and a["part"] != b["part"]:
                    met.add((a["rep"], b["rep"]))
    assert met == wanted
    assert len({c["cell"] for c in cells}) == len(cells) and {c["cell"].count(":") for c in cells} <= {1, 4}


@pytest.mark.parametrize("probing", [0, 25])
def test_a_group_of_many_unlike_members_stays_linear(spark, probing):
    """20,000 members, each a part of its own: rows grow with those that probe, not with the square."""
    count = 20_000
    rows = spark.range(count).select(
        F.lit("1:2").alias("g"), F.lit(-(-count // ngram_join.CELL)).alias("blocks"), F.lit(0).cast("byte").alias("role"), (F.col("id") >= probing).alias("skip"),
        F.lit(100).alias("n"), F.col("id").alias("key"), F.col("id").alias("rep"), F.lit(b"\x00" * 8).alias("bits"))
    cells = ngram_join.meeting_cells(rows, spark.createDataFrame([], LABEL)).select(F.size("members").alias("size")).collect()
    dealt = sum(c["size"] for c in cells)
    assert dealt <= (count + probing * (count // ngram_join.CELL + 2) if probing else 0)
    assert all(c["size"] <= 2 * ngram_join.CELL for c in cells)


def test_unlike_texts_with_a_common_opening_skip_its_groups(spark):
    """Texts of one long opening and own words: all can spare the signatures of the opening, so none is compared."""
    rng = random.Random(4)
    opening = " ".join(f"o{k}" for k in range(24))
    texts = [(i, opening + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(100))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = ngram_join.describe(docs, 5)
    classes = known.select("key", F.col("n_shingles").alias("n"), F.col("doc_id").alias("rep"), "spare0", "spare1", "bits0", "bits1").cache()
    found = ngram_join.signatures(docs, 4, 0, 5).groupBy("bucket").applyInArrow(lambda t: ngram_join.shared_groups(t, 0), ngram_join.GROUPS)
    lists = [F.first("keys").alias("keys"), F.first("roles").alias("roles"), F.sum("mult").alias("mult")]
    groups = found.withColumn("seed", F.lit(0)).groupBy("seed", "g1", "g2", "size", "piece").agg(*lists).cache()
    place = classes.withColumn("part", F.col("rep"))
    rows = ngram_join.mixed_members(groups, place)
    assert groups.where("size >= 40").count() > 0  # a text is in one of these where no own shingle falls into the opening's segment
    assert rows.where("not skip").count() == 0
    assert ngram_join.meeting_cells(rows, spark.createDataFrame([], LABEL)).count() == 0


def test_skipped_groups_lose_no_partner(spark, monkeypatch):
    """Texts of a few openings and own words, with partners as unlike as a link allows, against brute force."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    rng = random.Random(6)
    rows = []
    for i in range(0, 360, 2):
        size = rng.choice((20, 34, 60, 110))
        words = [f"o{i % 3}.{k}" for k in range(size // 2)] + [f"w{rng.randrange(10**9)}" for _ in range(size)]
        other = words[:]
        for _ in range(rng.randint(1, 2 + size // 25)):
            other[rng.randrange(len(other))] = f"w{rng.randrange(10**9)}"
        rows += [(i, " ".join(words)), (i + 1, " ".join(other[: len(other) - rng.randint(0, size // 12)]))]
    rng.shuffle(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    least = {i: i for i in sets}
    for _ in range(3):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert 60 < len(links) < 180  # some partners are just too far apart
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least
