"""The operators on a small table of hard cases, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from barlake.llm import chat, fingerprints, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, toxicity
from barlake.llm.common import connected_components
from barlake.llm.shingles import shingle_sets
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, score string, uid long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(90)
    texts = [None, "", " \n\t ", "one", "One", "a b c d", "a b c d e", "\x00odd \x00 text", base, base, base.replace(" ", "  "), passage, say(40) + " " + passage, passage + " " + say(60)]
    texts += ["aaaa" * 300, "aaaa" * 280, say(3000), "é ü ß 漢字 🙂 " * 90, "x | y | z | w | v", "### $$$ %%% &&& ***", "\n".join([say(8)] * 5)]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(120)] = "new"
        texts.append(" ".join(w))
    texts += [say(rng.randint(5, 80)) for _ in range(25)]
    rows = [(i, t, "en", "hot" if i % 3 else None, 1, "c", "s", 7) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, rows, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    twice = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    for how in ((P.path("byte_bpe_50k.tiktoken"), P.PATTERN), (P.path("byte_bpe_50k.json"),)):
        got = packing.pack_documents(twice, *how, max_len=256).collect()
        assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 for r in got)
        for i, t, *_ in rows:
            want = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
            pieces = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == i)
            assert b"".join(dict(pieces).values()) == want
        assert packing.pack_documents(empty, *how).count() == 0


def brute_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return out


def test_ngram_join(spark, rows, docs, empty):
    sets = brute_sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.join_components(empty).count() == 0


def test_segments_never_miss_a_partner():
    rng = np.random.default_rng(1)
    for n in [*range(3, 60), 90, 150, 400]:
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        for take in (0, n // 9, n // 7):
            r = np.unique(s[take // 2 :])
            if 4 * len(r) < 3 * n or not len(r):
                continue
            common = len(np.intersect1d(r, s))
            if 100 * common < 75 * (len(r) + n - common) or len(r) == n:
                continue
            sig = {(b, int(x)) for role, b, m, d, _ in ngram_join.plan(len(r)) if role == 0 for x in ngram_join.subsets(r, b, m, d, 0)[0]}
            probe = {(b, int(x)) for _, b, m, d, _ in ngram_join.plan(n) for x in ngram_join.subsets(np.unique(s), b, m, d, 0)[0]}
            assert ngram_join.spare(np.unique(s), np.array([n]))[0][0] > 0 or sig & probe


def test_suffix_dedup(rows, docs, empty):
    length = 64
    data = {i: (t or "").encode() for i, t, *_ in rows}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, length).collect()}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(r["kept"]) == kept and r["copy"] == "c"
    assert suffix_dedup.remove_repeats(empty, length).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_suffix_dedup_of_words(spark, docs, rows, block, monkeypatch):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = [(t or "").encode() for _, t, *_ in rows] + [b"x" * 150 + b" end " + b"y" * 99, b" \n ", b""]
    for t, (codes, start, end) in zip(texts, suffix_dedup.spelled(texts)):
        assert [t[a:z] for a, z in zip(start, end)] == words.findall(t) and len(codes) == 8 * len(start)
    n, length = 9, 200
    seen, seen_words = Counter(), Counter()
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for b in data.values():
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
        w = words.findall(b)
        seen_words.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    of_words = 0
    for r in suffix_dedup.remove_repeats(docs, length, n).collect():
        b = data[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        before = gone.sum()
        w = list(words.finditer(b))
        for k in range(len(w) - n + 1):
            if seen_words[tuple(x[0] for x in w[k : k + n])] > 1:
                gone[w[k].start() : w[k + n - 1].end()] = True
        of_words += gone.sum() > before
        assert bytes(r["kept"]) == np.frombuffer(b, np.uint8)[~gone].tobytes() and r["n_removed"] == gone.sum()
    assert of_words


def test_pipeline_removes_passages_of_over_50_words(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(5)

    def some(k):
        return " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 6))) for _ in range(k))

    passage, short, long = some(51), some(50), "".join(chr(97 + x) for x in rng.integers(0, 26, 450))
    assert len(passage) < 400
    around = [some(30) for _ in range(14)]
    texts = [f"{around[0]} {passage} {around[1]}", f"{around[2]}\n{passage}\n{around[3]}", passage.replace(" ", "  ")]
    texts += [f"{around[4]} {short} {around[5]}", f"{around[6]} {short} {around[7]}"]
    texts += [f"{around[8]} {long} {around[9]}", f"{around[10]} {long} {around[11]}", f"{around[12]} {around[13]}"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r["text"] for r in pipeline.without_repeats(spark, docs, "").collect()}
    assert [got[0], got[1], got[2]] == [f"{around[0]}  {around[1]}", f"{around[2]}\n\n{around[3]}", ""]
    assert [got[3], got[4], got[7]] == [texts[3], texts[4], texts[7]]
    assert got[5] + got[6] == f"{around[8]}{around[9]}{around[10]}{around[11]}"


def test_suffix_dedup_reads_long_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 5000).astype(np.uint8))
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors([text], 64, 64 - 26))]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors([text], 64, 64 - 26))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_language_model(rows, docs, empty):
    train = docs.where("doc_id % 4 <> 0")
    model = lm_scoring.fit(train.select("text"))
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</>"] for i, t, *_ in rows}
    uni, bi = Counter(), Counter()
    for i, w in tokens.items():
        if i % 4:
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
    d = lm_scoring.discounts(tuple(Counter(bi.values())[k] for k in (1, 2, 3, 4)))
    follows = Counter(v for _, v in bi)
    e = lm_scoring.discounts(tuple(Counter(follows.values())[k] for k in (1, 2, 3, 4)))
    n, total = len(bi), Counter()
    left = sum(e[min(c, 3) - 1] for c in follows.values()) / n
    spare = Counter()
    for (u, _), c in bi.items():
        total[u] += c
        spare[u] += d[min(c, 3) - 1]
    low = lambda w: max(follows[w] - e[min(follows[w], 3) - 1], 0) / n + left / (len(uni) + 1) if follows[w] else left / (len(uni) + 1)
    for i, w in tokens.items():
        s = 0.0
        for u, v in zip(["<s>", *w[:-1]], w):
            c = bi[(u, v)]
            s += np.log10((max(c - d[min(c, 3) - 1], 0) / total[u] if c else 0) + spare[u] / total[u] * low(v) if total[u] else low(v))
        base = sum(np.log10((uni[v] + 1) / (sum(uni.values()) + len(uni) + 1)) for v in w)
        assert got[i]["score"] == pytest.approx(s) and got[i]["base_score"] == pytest.approx(base) and got[i]["n_known"] == sum(uni[v] > 0 for v in w)
    assert lm_scoring.score(docs, lm_scoring.fit(empty.select("text"))).count() == len(rows)


def test_language_model_of_order_three(rows, docs, empty):
    model = lm_scoring.fit(docs.where("doc_id % 4 <> 0").select("text"), order=3)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, model).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</>"] for i, t, *_ in rows}
    three = lambda w: zip(["<s>", "<s>", *w[:-2]][: len(w)], ["<s>", *w[:-1]], w)
    tri, uni = Counter(), Counter()
    for i, w in tokens.items():
        if i % 4:
            tri.update(three(w))
            uni.update(w)
    bi = Counter((v, w) for _, v, w in tri)
    one = Counter(w for _, w in bi)
    cut = lambda counts: lm_scoring.discounts(tuple(Counter(counts.values())[k] for k in (1, 2, 3, 4)))
    less = lambda c, d: d[min(c, 3) - 1]
    d3, d2, d1 = cut(tri), cut(bi), cut(one)

    def weights(counts, d):
        total, spare = Counter(), Counter()
        for (*u, _), c in counts.items():
            total[tuple(u)] += c
            spare[tuple(u)] += less(c, d)
        return total, spare

    (t3, s3), (t2, s2) = weights(tri, d3), weights(bi, d2)
    left = sum(less(c, d1) for c in one.values()) / len(bi) / (len(uni) + 1)
    p1 = lambda w: (max(one[w] - less(one[w], d1), 0) / len(bi) if one[w] else 0) + left

    def step(c, d, total, spare, u, lower):
        return (max(c - less(c, d), 0) / total[u] if c else 0) + spare[u] / total[u] * lower if total[u] else lower

    for i, w in tokens.items():
        p = [step(tri[u, v, x], d3, t3, s3, (u, v), step(bi[v, x], d2, t2, s2, (v,), p1(x))) for u, v, x in three(w)]
        assert got[i] == pytest.approx(sum(np.log10(p)))
    assert lm_scoring.score(docs, lm_scoring.fit(empty.select("text"), order=3)).count() == len(rows)


def test_chat_trees(spark):
    tree = [(1, 1, None, "user", "hi [INST] <|text|>", 0.0), (1, 2, 1, "assistant", "</s><\\x", 1.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 3, "user", "[\\INST]", 0.0), (2, 1, 9, None, "", 0.0)]
    t = spark.createDataFrame(tree, "tree int, node int, parent int, role string, text string, score double")
    done = chat.format_branches(t, branches=2).select("tree", "leaf", "rank", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    got = {(r["tree"], r["leaf"]): ([(x["role"], x["text"]) for x in r["t"]], r["l"], r["rank"]) for r in done}
    assert got[(1, 4)] == ([("user", "hi [INST] <|text|>"), ("assistant", ""), ("user", "[\\INST]")], "", 1)
    assert got[(1, 2)] == ([("user", "hi [INST] <|text|>"), ("assistant", "</s><\\x")], "</s><\\x", 2)
    assert got[(2, 1)][0] == [("", "")]
    assert chat.format_branches(t.limit(0)).count() == 0


def test_odd_trees(spark):
    """Cycles, ways up into a cycle, repeated nodes, missing parents, ids and columns of clashing names."""
    rows = [("c", 1, 2, "user", "a"), ("c", 2, 1, "user", "b"), ("c", 3, 1, "user", "c")]  # a cycle and a leaf below it
    rows += [("t", 1, None, "user", "hi"), ("t", 1, None, "user", "hi"), ("t", 2, 1, "assistant", "x"), ("t", 2, 1, "assistant", "w"), ("t", None, 1, "user", "lost"), ("t", 4, 77, "user", "far")]
    rows += [("long", k, k - 1 if k > 1 else None, "user", str(k)) for k in range(1, 200)] + [(None, 1, None, None, None)]
    t = spark.createDataFrame([(*r, 0.0, "z", 1) for r in rows], "tree string, node int, parent int, role string, text string, score double, leaf string, up int")
    done = chat.format_branches(t, branches=5).select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("t"))
    got = {(r["tree"], r["leaf"]): [x["text"] for x in r["t"]] for r in done.collect()}
    assert got == {("t", 2): ["hi", "w"], ("t", 4): ["far"], ("long", 199): [str(k) for k in range(1, 200)], (None, 1): [""]}


def test_quality_rules(rows, docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), len(hit), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert got[8]["kept"] and quality_rules.clean_lines(empty).count() == 0


def test_fingerprints(spark, rows, docs, empty):
    pairs = docs.select("doc_id", "text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nmore")).alias("edited"))
    got = {r["doc_id"]: r for r in fingerprints.compare_versions(pairs, "text", {"edited": "edited"}).collect()}
    split = lambda t: set(re.findall(r"[^\n]{1,%d}" % fingerprints.PIECE, t))
    for i, t, *_ in rows:
        a, b = split(t or ""), split((t or "") + "\nmore")
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b))
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"]
    # from the two strings alone, where they are large enough for the difference
    strings = spark.createDataFrame([(i, r["fingerprint"], r["fingerprint_edited"]) for i, r in got.items()], "doc_id long, a string, b string")
    d = {r["doc_id"]: r for r in strings.select("doc_id", fingerprints.pieces_of(F.col("a")).alias("n"), fingerprints.differences(F.col("a"), F.col("b")).alias("d")).collect()}
    for i, t, *_ in rows:
        n, d1 = d[i]["n"], d[i]["d"]
        assert d1["ok"] and n == len(split(t or "")) and got[i]["near_edited"] == pytest.approx((n - d1["p"]) / (n + d1["q"]) if n + d1["q"] else 1.0)


def test_fingerprints_far_apart(spark):
    """Differences beyond a fingerprint: larger sketches, some of them twice; repeated rows and null ids; clashing names."""
    rng = random.Random(9)
    texts = ["\n".join(str(rng.random()) for _ in range(n)) for n in (0, 1, 7, 30, 100, 400, 1500)]
    data = [(k if k % 3 else None, a, b, k) for k, (a, b) in enumerate([(a, b) for a in texts for b in texts] * 2)]
    pairs = spark.createDataFrame(data, "doc_id long, id string, text string, d int")
    got = fingerprints.compare_versions(pairs, "id", {"x": "text"}).collect()
    want = Counter()
    for i, a, b, k in data:
        x, y = set(a.split("\n")) - {""}, set(b.split("\n")) - {""}
        want[(i, k, round(len(x & y) / len(x | y) if x | y else 1.0, 9))] += 1
    assert Counter((r["doc_id"], r["d"], round(r["near_x"], 9)) for r in got) == want
    assert fingerprints.compare_versions(pairs.limit(0), "id", {"x": "text"}).count() == 0


def test_next_documents(spark, rows, docs, empty):
    after = {r["doc_id"]: r["following"] for r in fingerprints.next_documents(docs).collect()}
    ids = [r[0] for r in rows]
    assert all(after[i] == (rows[(k + 1) % len(rows)][1] or "") for k, i in enumerate(ids))
    assert fingerprints.next_documents(empty).count() == 0


def test_channel_restores_disguises():
    words = Counter({"idiot": 40, "clown": 40, "stupid": 40, "loser": 40, "the": 400, "and": 300, "inter": 100, "letter": 60})
    c = toxicity.Channel(dict(toxicity.trigrams(words)))
    for odd, plain in (("1d10t", "idiot"), ("cl0wn", "clown"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("id!ot", "idiot"), ("the", "the"), ("2024", "2024")):
        assert c.restore_token(odd) == plain
    assert c.spaced("you i d i o t !") == ["idiot"] and "loser" in c.restore("a L 0 S E R, no".replace("0", "o"))


def language():
    words = Counter({"you": 300, "are": 300, "the": 400, "an": 200, "such": 80, "idiot": 30, "clown": 30, "stupid": 30, "loser": 30, "letter": 60, "well": 90, "known": 80})
    return toxicity.Channel(dict(toxicity.trigrams(words)), words=dict(words))


def test_spaced_runs_of_any_length_are_words():
    c = language()
    assert c.cut("youidiot") == ["you", "idiot"] and "idiot" in c.spaced("y o u 1 d 1 o t")
    long = ["you", "are", "such", "an", "idiot"] * 40
    got = c.spaced(" ".join("".join(long)))
    assert got[: len(long)] == long
    assert c.restore_token(".".join("loser" * 20)).count("loser") == 20 and c.spaced("y o u s t u u p i d l o s s e r")[:3] == ["you", "stupid", "loser"]


def test_marks_and_doubled_letters_inside_words():
    c = language()
    for odd, plain in (("id-iot", "idiot"), ("stu.pid", "stupid"), ("lo_ser", "loser"), ("stuupid", "stupid"), ("idioot", "idiot"), ("id-ioot,", "idiot")):
        assert c.restore_token(odd) == plain
    for plain in ("well-known", "letter", "you-idiot", "the.clown", "well", "such-an"):
        assert c.restore_token(plain) == plain


def test_few_doubled_letters_are_read_as_by_the_search():
    """The short way for letters alone gives what the search gives."""
    rng = random.Random(9)
    c = language()
    known = [w for w in c.known if w.isalpha()]
    odd = ["".join(rng.choice("abcdeilost") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for w in rng.choices(known, k=300) + odd:
        for _ in range(3):
            i = rng.randrange(len(w))
            w = w[: i + 1] + w[i:]
            pairs = [k for k in range(1, len(w)) if w[k] == w[k - 1]]
            if not toxicity._LONG_RUN.search(w) and len(pairs) <= 4:
                assert c.undoubled(w, w, pairs) == c.by_search(w, w)


def test_long_runs_and_long_tokens_find_their_word():
    c = language()
    assert c.restore_token("stu" + "u" * 500 + "pid") == "stupid" and c.restore_token("st" + "u" * 60 + "pid") == "stupid"
    assert c.restore_token("l-o-s-e-r") == "loser"


def test_a_reading_is_the_same_in_a_larger_corpus():
    """Counts ten and a thousand times as large, and many rare words beside them, change no reading of these disguises."""
    words = Counter({"you": 300, "are": 300, "the": 400, "an": 200, "such": 80, "idiot": 30, "clown": 30, "stupid": 30, "loser": 30, "letter": 60, "well": 90, "known": 80})
    texts = ["st0pid", "y o u i d i o t", "lo-ser", "stuupid", "id-ioot", "letter", "well-known", "s t u u p i d l o s e r"]

    def read(k):
        c = toxicity.Channel(dict(toxicity.trigrams(Counter({w: n * k for w, n in words.items()}))), words={w: n * k for w, n in words.items()})
        return [c.restore(t) for t in texts]

    assert read(1) == read(10) == read(1000)


def test_a_spaced_sentence_is_toxic():
    c = language()
    m = toxicity.Model(c.grams, {"idiot": 3.0}, (-2.0, 1.0, 1.0, 0.0))
    said = " ".join("youarethesuchanyouarethesuchanyouarethesuchanyouarethesuchanyouareanidiot")
    assert toxicity.summary(toxicity.Readings(c, m.hits), said)[0] == pytest.approx(np.log(4))


def test_toxicity_and_quality_learn(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(30)]
        if toxic := i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["idiot", "1d1ot", "clown"])
        if bad := i % 5 == 0:
            w = ["###" + x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", "s", 1, "c", "s", 7))
        labels.append((i, int(not bad), int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    half = labels.where("doc_id % 2 = 0")
    tox = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, half)).collect()}
    held = [(i, t) for i, _, t in labels.collect() if i % 2 or i % 4 == 0]
    assert np.mean([tox[i] == t for i, t in held]) > 0.95
    ranking = quality_classifier.fit(docs, labels.where("doc_id % 3 > 0"))
    got = {r["doc_id"]: r["predicted"] for r in quality_classifier.score_quality(docs, ranking).collect()}
    assert np.mean([got[r[0]] == r[1] for r in labels.collect()]) > 0.97
    blank = spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)
    assert 0 <= quality_classifier.score_quality(blank, ranking).first()["score"] <= 1


def test_quality_learns_from_every_row_and_pair(spark):
    """The weights are the optimum of all pairs, the threshold is a rank of all rows, more than 20,000 here."""
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "be", "cat,", "Dog.", "#1", "|", "EEE!", "f2f"])
    kinds = [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(700)]
    texts = [kinds[i % 700] for i in range(21_000)]
    good = [int(t.count("#") + t.count("!") + rng.randrange(4) < 7) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    some = labels.where("doc_id < 1400")
    got = quality_classifier.fit(docs, some)
    assert quality_classifier.fit(docs.repartition(7), some.repartition(5)) == got
    x = np.array([quality_classifier.text_features(t) for t in texts])
    y = np.array(good[:1400])
    z = (x[:1400] - x[:1400].mean(0)) / np.where(x[:1400].std(0) < 1e-9, 1, x[:1400].std(0))
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    grad = -(d / (1 + np.exp(d @ np.array(got.weights)))[:, None]).mean(0) + 1e-3 * np.array(got.weights)
    assert np.abs(grad).max() < 5e-4  # bins of the score are a sixteenth wide
    every = quality_classifier.fit(quality_classifier.with_features(docs, ["doc_id"]), labels)
    s = np.sort(((x - np.array(every.mean)) / np.array(every.scale) * np.array(every.weights)).sum(1))
    n_bad = good.count(0)
    assert every.mean == pytest.approx(x.mean(0)) and every.threshold == pytest.approx((s[n_bad - 1] + s[n_bad]) / 2, abs=1e-12)


def test_mixing(docs, rows, empty):
    out = mixing.mix_sources(docs, epochs=3.0)
    n = Counter(r["doc_id"] for r in out.collect())
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, epochs=3.0).collect()}
    for i, t, _, source, *_ in rows:
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, term = rates[source or ""], 0, np.exp(-rates[source or ""])
        total = term
        while u >= total and k < 200:
            k += 1
            term *= rate / k
            total += term
        assert n[i] == k
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_draws_large_rates(spark, monkeypatch):
    rows = [(i, "ab", "rare") for i in range(40)] + [(99, "x" * 300_000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = next(r["rate"] for r in mixing.source_rates(docs, {"rare": 1.0, "big": 3.0}).collect() if r["source"] == "rare")
    assert rate == pytest.approx(0.25 * 300_080 / 80)
    monkeypatch.setattr(mixing, "BLOCK", 100)
    copies = {}
    for r in mixing.mix_sources(docs, {"rare": 1.0, "big": 3.0}).where("source = 'rare'").select("doc_id", "copy").collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    m = int(np.ceil(rate / 500))
    for i in range(40):
        n = 0
        for j in range(1, m + 1):
            u = int(hashlib.md5((f"mix:{i}" if j == 1 else f"mix:{i}:draw:{j}").encode()).hexdigest()[:13], 16) / 2**52
            term = total = np.exp(-rate / m)
            k = 0
            while u >= total:
                k += 1
                term *= rate / m / k
                total += term
            n += k
        assert sorted(copies[i]) == list(range(1, n + 1))
    assert abs(np.mean([len(x) for x in copies.values()]) - rate) < 5 * np.sqrt(rate / 40)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s.split()[0] for s, _ in pipeline.STAGES] == ["quality", "n-gram", "suffix-array", "mixing", "packing"]
    kept = pipeline.one_of_each_group(spark, docs, sf).toPandas()
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs).collect()}
    assert set(kept["doc_id"]) == {i for i, c in groups.items() if i == c} and list(kept.columns) == docs.columns
    cut = pipeline.without_repeats(spark, docs, sf).toPandas()
    assert len(cut) == docs.count() and (cut["text"].str.len() == cut["n_chars"]).all()
    assert zlib and len(list(shingle_sets([b"a b c d e f"]))[0]) == 2
