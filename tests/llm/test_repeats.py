"""Operator 12 against a plain search of all runs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from sonora.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def period_of(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i - q] for i in range(q, len(words))))


def brute(words, min_exp=4, least=6):
    """Every stretch whose ends can't be moved out, by its definition."""
    n, out = len(words), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, min_exp * q) and period_of(words[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)), len(words))


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    prose = lambda n: [f"w{rng.randint(0, 40)}" for _ in range(n)]
    out = [None, "", " \n\t", "x", "x " * 5, "x " * 6, "a b " * 3, "a b " * 4, "a b c" * 9, "A a " * 30, "é\U0001f600 ü " * 12, " ".join(prose(3000))]
    out += [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(120)]
    for _ in range(60):
        unit = prose(rng.randint(1, 12)) * rng.randint(2, 7)
        out.append(" \n".join(prose(rng.randint(0, 20)) + unit + unit[: rng.randint(0, 3)] + prose(rng.randint(0, 9)) + [word()] * rng.randint(0, 9)))
    return out


@pytest.mark.parametrize("long", [1 << 17, 60])
def test_whole_query(spark, monkeypatch, long):
    """All texts where they are read, and all but the shortest dealt out by single lags and few words at a time."""
    monkeypatch.setattr(repeats, "LONG", long)
    if long == 60:
        monkeypatch.setattr(repeats, "UNIT", 100)
        monkeypatch.setattr(repeats, "TOGETHER", 50)
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(texts())] + [(None, "a b " * 20, None, None, None), (8, "A a " * 30, "en", 2, "y"), (8, "A a " * 30, "en", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, spot int, runs string").repartition(3)
    held = repeats.with_periods(df)
    assert held.columns == df.columns
    got = repeats.run_digest(repeats.periodic_runs(held)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((digest(*r[:2]) for r in rows), key=key)
    assert any(zlib.crc32(b"%d" % i) % 10 == 0 for i in range(len(rows)))
    assert repeats.periodic_runs(df.limit(0)).count() == 0


def test_other_exponents_and_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = repeats.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_exp=2, least=3).collect()
    for r in found:
        words = WORD.findall(rows[r.doc_id][1] or "")
        runs = brute(words, 2, 3)
        assert [tuple(x) for x in r.runs] == runs
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
    with pytest.raises(ValueError):
        repeats.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_exp=1)


def test_a_very_long_text_is_dealt_out(spark):
    """200,000 characters of one run within others: more lags than one range holds."""
    rng = random.Random(1)
    line = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    words = line * 9 + ["z"] * 50 + line[:100]
    df = spark.createDataFrame([(5, " ".join(words))], "doc_id long, text string")
    assert len(df.first().text) > repeats.LONG
    [row] = repeats.periodic_runs(df).collect()
    assert [tuple(r) for r in row.runs] == [(0, 27000, 3000), (27000, 50, 1)]
    assert row.collapsed == " ".join([*line, "z", *line[:100]])
