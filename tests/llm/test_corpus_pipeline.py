"""The corpus pipeline against a plain Python chain, stage by stage and as a whole."""

import hashlib
import math
import random
import re
import struct
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import brute_components, brute_personal  # noqa: E402

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `rate` double, `_n` string, `copy` int, `key` string, place int"


def table(spark, rows, folder):
    docs = spark.createDataFrame([(*r, 0.5, "n", 7, "k", i) for i, r in enumerate(rows)], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return docs


def sample():
    rng = random.Random(31)
    syllables = "an re the ti on er le mo ka zu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, texts = prose(120), [None, "", "one two"]
    for k in range(5):
        words = base.split()
        words[20 * k] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [base, base] + [prose(rng.randint(20, 90)) for _ in range(60)]
    texts += [f"{prose(30)} me{k}@example.org or 10.0.0.{k} or 4111 1111 1111 1111 {prose(10)}" for k in range(10)]
    toxic = [f"{prose(40)} vilefool {prose(5)} Scoundrel! {prose(4)}" for _ in range(50)]
    texts += toxic + [prose(3000)]
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[40], (None, texts[12], None, None, None), (None, prose(50), None, None, None)]
    labels = [(i, int(t in toxic)) for i, t in enumerate(texts) if t and len(t) > 60]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = sample()
    table(spark, rows, d)
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def key(r):
    return (r[0], r[1])


def poisson(doc_id, rate):
    name = "" if doc_id is None else str(doc_id)
    u = (int(hashlib.md5(f"7:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    p = c = math.exp(-rate)
    k = 0
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def brute_pieces(rows):
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")), Counter()
    for d, t in rows:
        ids, start = whole.encode(t or "", add_special_tokens=False).ids + [1], 0
        while start < len(ids):
            left = len(ids) - start
            n = 2048 if left >= 2048 else 1 << (left.bit_length() - 1)
            out[d, start, struct.pack(f"<{n}I", *ids[start : start + n]), len(ids)] += 1
            start += n
    return out


def brute_chain(rows, rejected):
    kept = [r for r in rows if key(r) not in rejected]
    # One row of each group: smallest id, null ids last.
    named = [(d, t or "") for d, t, *_ in kept]
    groups, out = defaultdict(list), []
    for r, root in zip(kept, roots(named)):
        groups[root].append(r) if root is not None else out.append(r)
    out += [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    masked = []
    for d, t, *rest in out:
        spans = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in brute_personal(t or "")))
        new, done = "", 0
        for s, e, k in spans:
            if s >= done:
                new += (t or "")[done:s] + f"[{k.upper()}]"
            done = max(done, -e)
        masked.append((d, new + t[done:] if t is not None and spans else t, rest[1]))
    n, count = len(masked), Counter(s for *_, s in masked)
    total = sum(math.sqrt(c) for c in count.values())
    rate = {s: math.sqrt(c) / total * n / c for s, c in count.items()}
    return out, masked, [(d, t) for d, t, s in masked for _ in range(poisson(d, rate[s]))]


def roots(named):
    """A group's number for each row, None without shingles; by comparing all pairs."""
    numbered = brute_components([(i, t) for i, (_, t) in enumerate(named)], 5, 80)
    of = {i: (c if n else None) for i, n, c in numbered}
    return [of[i] for i in range(len(named))]


def test_chain(spark, folder):
    import corpus_pipeline as P
    from sonora.llm import toxicity

    rows, labels = sample()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {r["doc_id"] for r in scored if r["predicted"]}
    assert {i for i, x in labels if x} == bad  # the planted words are learned, nothing else is rejected
    unique, masked, copies = brute_chain(rows, {key(r) for r in rows if r[0] in bad})
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
    now, seen = docs, []
    for name, stage in P.STAGES:
        now = stage(spark, now, folder)
        seen.append(now)
        if name != "packing":
            assert now.columns == docs.columns
            now.write.parquet(f"{folder}/out_{name}")
            now = spark.read.parquet(f"{folder}/out_{name}")
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{folder}/out_{name}").select("doc_id", "text").collect()]
    assert Counter(read("toxicity")) == Counter(key(r) for r in rows if r[0] not in bad)
    assert Counter(read("near_copies")) == Counter(key(r) for r in unique)
    assert Counter(read("personal_data")) == Counter((d, t) for d, t, _ in masked)
    assert sum("[EMAIL]" in (t or "") and "[IP]" in t and "[CARD]" in t for _, t in read("personal_data")) == 10
    assert Counter(read("mixing")) == Counter(copies)
    for whole in (seen[-1], P.run(spark, folder)):
        found = whole.collect()
        assert Counter((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in found) == brute_pieces(copies)
        assert len({r["sequence_id"] for r in found}) == len(found) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 for r in found)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    table(spark, [], tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


ODD = ["", " ", "It's a test, isn't it? We'll see; they've 12 & I'd 3.5", "x" * 401, "ab" * 900 + " end", "ÀÉÎõü ß ÿ Ÿ İ ı ſ", "naïve café", "é café", "中文 日本語", "\U0001f600\U0001f468‍\U0001f469", "<|startoftext|> a <|endoftext|>", "a\x00b\x01c\x7f", "a b c　d", "under_score __x__ 1_000", "²³½ Ⅷ", "tab\tnew\nline\r\x0b\x0c", "'S 'T 'RE DON'T", "!!!???...,,,--==", "ʼ’s", "﻿bom", "A" * 50 + "1" * 50, "İstanbul ẞ", "a'b'c ''' 's's"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    from sonora.llm.packing import word_tokenizer
    from tokenizers import Tokenizer

    path = tokenizers.path(name)
    whole, own, rng = Tokenizer.from_file(path), word_tokenizer(path), random.Random(2)
    letters = "abcXYZ 019'._-!?\t\néßñ́İ中\U0001f600"
    for t in ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]:
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_of_megabytes(spark):
    """One very long text and one of a single repeated word, through every operator that reads texts."""
    from sonora.llm import jaccard, mixing, packing, pii, quality, secrets, suffixes, toxicity

    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randint(0, 99)) for _ in range(150_000))
    same = "word " * 100_000
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, same, "en", "a", 1), (3, long[:-8] + " changed", "en", "a", 1), (4, "short text", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.link(docs).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4)}
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(docs).collect()}
    assert cut[1][1] >= len(long) - 8 - 200 and cut[2] == (500_000, 500_000) and cut[4][1] == 0
    assert pii.find_personal(docs).count() == secrets.find_secrets(docs).count() == toxicity.score(docs, labels).count() == 4
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert judged[1]["n_words"] == 150_000 and judged[2]["n_repeat_words"] == 100_000 and judged[2]["base_failed"]
    tokens = packing.pack(docs, tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").sum("length").collect()
    assert len(tokens) == 4 and mixing.replicate(docs, {"a": 1.0, "b": 1.0}).count() > 0


def test_more_empty_tables(spark):
    from sonora.llm import chat, jaccard, mtree, packing, pii, toxicity

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (packing.pack(none, tokenizers.path("word_bpe_49k.json")), toxicity.reject(none, labels), pii.redact(none), jaccard.keep_one(none), mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")), chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tokenizers.path("byte_bpe_50k.json"))):
        assert df.count() == 0


def test_high_rates_are_of_poissons_distribution(spark):
    """A rare source of a large target weight: mean and variance of its counts are those of the rate."""
    from sonora.llm import mixing

    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 8 = 0, 'rare', 'often') AS source")
    weights = {"rare": 7.0, "often": 1.0}
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, weights).collect()}
    assert rate["rare"] == pytest.approx(7.0)
    docs = spark.range(40_000).selectExpr("id AS doc_id", "IF(id % 80 = 0, 'rare', 'often') AS source")
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, {"rare": 50.0, "often": 50.0}).collect()}["rare"]
    counts = Counter(r["doc_id"] for r in mixing.replicate(docs, {"rare": 50.0, "often": 50.0}).filter("source = 'rare'").select("doc_id").collect())
    x = [counts[i] for i in range(0, 40_000, 80)]
    mean = sum(x) / 500
    assert rate == pytest.approx(40.0) and abs(mean - 40) < 4 * math.sqrt(40 / 500) and 30 < sum((v - mean) ** 2 for v in x) / 499 < 52


def test_many_sources_meet_by_salt(spark, monkeypatch):
    from sonora.llm import mixing

    docs = spark.range(500).selectExpr("id AS doc_id", "IF(id % 7 = 0, null, 's' || id % 5) AS source", "'x' AS _salt")
    want = Counter((r["doc_id"], r["copy"]) for r in mixing.replicate(docs).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    many = mixing.replicate(docs)
    assert many.columns == [*docs.columns, "copy", "shuffle_key"] and Counter((r["doc_id"], r["copy"]) for r in many.collect()) == want


def test_quality_scores_by_plain_python(spark):
    """Ratios, scores, the limit and ``kept`` from the hashes of words and pairs."""
    from pyspark.sql import functions as F

    from sonora.llm import quality

    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary[: 12 if i % 3 else 40]) for _ in range(rng.randint(0, 120))) for i in range(60)] + [None, "same " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (1, texts[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 40)] + [(4, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    cells, good = 256, {i for i in range(40) if i % 3 > 0}
    pairs = [(a,) for a in [*vocabulary, "same"]] + [(a, b) for a in [*vocabulary, "same"] for b in [*vocabulary, "same"]]
    hashed = spark.createDataFrame([(*p, None)[:2] for p in pairs], "a string, b string").select("a", "b", F.pmod(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(cells)).alias("h"))
    cell = {(r["a"],) if r["b"] is None else (r["a"], r["b"]): r["h"] for r in hashed.collect()}

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return [cell[(a,)] for a in w] + [cell[p] for p in zip(w, w[1:])]

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw, trusted = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in good:
            trusted.update(grams(t))
    n, m = sum(raw.values()) + cells, sum(trusted.values())
    mass = 0.01 * (m + cells)
    ratio = [round(math.log((trusted[b] + mass * (raw[b] + 1) / n) / (m + mass) / ((raw[b] + 1) / n)), 6) for b in range(cells)]
    score = [sum(ratio[b] for b in grams(t)) / max(1, len(grams(t))) for _, t in rows]
    long = [s for (d, t), s in zip(rows, score) if d in good and len((t or "").split()) >= 50]
    mean = sum(long) / len(long)
    limit = mean - 1.0 * math.sqrt(sum((s - mean) ** 2 for s in long) / len(long))
    got = quality.judge(docs, labels, cells, 1.0).collect()
    want = Counter((d, round(s, 5), (not r) and s >= limit) for (d, t), s, r in zip(rows, score, [failed(t) for _, t in rows]))
    assert Counter((r["doc_id"], round(r["score"], 5), r["kept"]) for r in got) == want
    assert len({r["kept"] for r in got if not r["base_failed"]}) == 2


def failed(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(cover) > 50 * len(w)
