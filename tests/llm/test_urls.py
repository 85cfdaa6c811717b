"""Operator 11 against plain string rules and regular expressions."""

import random
import re

import pytest

from sonora.llm import urls

ODD = [None, "", "no scheme", "://", "http://", "http://COM", "https://a.Com/x", "http://example.com/en/1", "HTTP://WWW.Example.com/en/1?q=/es/", "http://x.www.example.com/en/", "http://notexample.com/en/", "http://.example.com/en/z",
       "http://a.net/es/#t", "http://a.net#/es/", "http://a.net?x/fr/", "http://net/fr/", "http://a/x.example.com/en/", "a://b://c.com/", "http://é\U0001f600casino.org/ü", "http://user@a.net:80/es/", "http://p.org/../wp-login.php", "http://p.org/a\nb.exe", "http://xxx12.org", "http://antispam.org/x"]


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def regex(glob):
    """One glob as Python's regular expression, by replacing its signs."""
    out = re.sub(r"\\\*\\\*|\\\*|\\\?|\\\[(!?)(.+?)\\\]", lambda m: {r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}.get(m[0]) or f"[{'^/' if m[1] else ''}{m[2]}]", re.escape(glob).replace(r"\-", "-").replace("!", "!"))
    return f"(?s){out}(/.*)?" if "/" not in glob and "**" not in glob else f"(?s){out}"


def judge(url, rules, globs):
    host, path = parts(url)
    fits = [(h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *(x := max(fits, key=lambda f: len(f[0])))[:1], None, x[1]
    plain = lambda g: len(re.sub(r"\[.+?\]", "x" if "[!" not in g else "", re.sub(r"[*?]", "", g)))
    for a, g in sorted(globs, key=lambda x: -plain(x[1])):
        if re.fullmatch(regex(g), host + path):
            return host, path, None, g, a
    return host, path, None, None, "allow"


def test_whole_query_by_plain_rules(spark):
    rng = random.Random(4)
    some = lambda xs: rng.choice(xs)
    made = [f"http{some(['', 's'])}://{some(['', 'www.', 'm.', 'casino.', 'Spam-'])}{some(['example', 'cheap-pills', 'xxx7', 'a.b', 'poker'])}.{some(['com', 'net', 'org', 'COM'])}{some(['', '/', '/en/', '/es/', '/fr/', '/x/cart/y', '/q.exe', '/wp-login.php'])}{some(['', 'a', '?u=1', '#/en/', 'b.zip'])}" for _ in range(600)]
    long = "http://a.org/" + "x" * 70_000 + ".exe"
    rows = [(i, u, "<p>", 1, "h", "r") for i, u in enumerate([*ODD, *made, long, made[0]])] + [(None, made[0], None, None, None, None), (3, ODD[3], None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, url_verdict int, host string, rule string").repartition(4)
    got = urls.url_digest(pages).collect()
    want = [(r[0], *judge(r[1], urls.RULES, urls.GLOBS)) for r in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = urls.allowed(pages)
    assert kept.columns == pages.columns
    assert kept.count() == sum(w[-1] == "allow" for w in want)
    assert urls.url_digest(pages.limit(0)).count() == 0


def test_many_rules_over_many_words(monkeypatch):
    """Hundreds of patterns: carries from word to word, blocks of urls, and the order of precedence."""
    import numpy as np

    monkeypatch.setattr(urls, "STATE_WORDS", 700)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = tuple(dict.fromkeys((rng.choice(["allow", "block"]), f"{word()}.{word()}", rng.choice(["", "/", f"/{word()}", word()])) for _ in range(150)))
    rules = tuple({(h, p): (a, h, p) for a, h, p in rules}.values())
    globs = tuple({g: (rng.choice(["allow", "block"]), g) for g in (rng.choice(["*", "**", "?", "[a-b]", "[!a]"]) + word() + rng.choice(["*", "**", "?", "/**", ""]) for _ in range(150))}.values())
    made = [f"http://{word()}.{word()}.{word()}/{word()}{rng.choice(['', '/'])}{word()}" for _ in range(500)]
    machine = urls.UrlAutomaton(rules, globs)
    assert machine.words > 20
    texts = ["".join(parts(u)) for u in made]
    at = np.cumsum([0, *map(len, texts)])
    first = machine.first(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at)
    for u, f in zip(made, first.tolist()):
        rule, glob, verdict = machine.verdicts[f] if f >= 0 else (None, None, "allow")
        want = judge(u, rules, globs)
        assert (rule is None, glob is None, verdict) == (want[2] is None, want[3] is None, want[4]) and len(rule or "") == len(want[2] or ""), u


def test_rules_are_checked():
    with pytest.raises(ValueError):
        urls.UrlAutomaton((("maybe", "com", "/"),), ())
    assert urls.UrlAutomaton((), ()).verdicts == []
