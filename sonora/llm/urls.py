"""Operator 11, URL filters: a bit-parallel wildcard automaton.

The canonical URL of a page is its host, A-Z lower-cased, and its path, without scheme, query and fragment. Two kinds of
rules judge it: (action, host, path) rules, which fit a host with all its subdomains and the paths that begin with theirs,
and globs over the whole canonical URL. Both become patterns of one Shift-And automaton: each pattern has a bit for its
start and one for each step behind it, all patterns lie end to end in as many 64-bit words as they need, and a character
moves all states of all patterns at once: ``D = ((D << 1) & step[c]) | (D & loop[c])``, the carry going from word to word.
A wildcard run is a state that keeps itself (``loop``), so it costs no state and no backtracking. The patterns lie in the
order of their precedence, so the lowest final bit is the verdict: host and path rules before globs, longer ones first
(characters of host and path; then longer hosts, then the order given), globs by their number of plain characters, then
the order given. What nothing fits is allowed.

Globs: ``?`` is one character and ``*`` any run, both without slashes; ``**`` any run; ``[a-f0-9]`` one character of a set,
``[!a-f]`` one outside it, no slash. A glob without a slash judges hosts, whatever their path.

URLs of an Arrow batch are simulated together, longest first, in blocks whose states fill at most ``STATE_WORDS`` words,
so memory is bounded however many rules there are. There is no shuffle; only urls travel to Python, no page texts.

Defined cases: a null url or one without ``://`` has an empty host and path, which only globs of empty runs fit; hosts keep
ports, user names and empty labels as they are; very long urls take a step for each character; rows that repeat are judged
each; an empty table gives no rows; other columns are kept by ``judged`` and not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free_name

Rule = tuple[str, str, str]
Glob = tuple[str, str]

#: The contract's rules.
RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What rules leave open: hosts named like advertising farms, and paths that hold no prose.
GLOBS: tuple[Glob, ...] = (
    ("block", "*casino*"), ("block", "*-pills.*"), ("block", "*spam*"), ("block", "*poker*"), ("block", "xxx[0-9]*.*"),
    ("block", "**/wp-login.php"), ("block", "**/cart/**"), ("block", "**.exe"), ("block", "**.zip"), ("allow", "*antispam*"),
)
#: 64-bit words of states that a block of urls may fill.
STATE_WORDS = 1 << 20
SLASH = ord("/")

# A step of a pattern: a frozenset of code points, or (frozenset,) for all others but the slash. A run: RUN or ALL_RUN.
RUN, ALL_RUN = "*", "**"


def glob_steps(glob: str) -> list:
    """The steps and runs of a glob."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if glob.startswith("**", i):
            out.append(ALL_RUN)
            i += 1
        elif c == "*":
            out.append(RUN)
        elif c == "?":
            out.append((frozenset(),))
        elif close > 0:
            body = glob[i + 1 : close]
            outside, body = body.startswith("!"), body.removeprefix("!")
            points, k = set(), 0
            while k < len(body):
                far = 2 if body[k + 1 : k + 2] == "-" and k + 2 < len(body) else 0
                points |= set(range(ord(body[k]), ord(body[k + far]) + 1))
                k += far + 1
            points -= {SLASH}
            out.append((frozenset(points),) if outside else frozenset(points))
            i = close
        else:
            out.append(frozenset([ord(c)]))
        i += 1
    return out


class UrlAutomaton:
    """All patterns of rules and globs in one Shift-And automaton."""

    def __init__(self, rules: tuple[Rule, ...], globs: tuple[Glob, ...]) -> None:
        plain = lambda text: [frozenset([ord(c)]) for c in text]
        ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
        patterns: list[tuple[list, tuple[str | None, str | None, str]]] = []
        for action, host, path in ranked:
            # A url's path is empty or begins with a slash: a rule's empty path fits both, one that begins otherwise fits none.
            tails = [[], [*plain("/"), ALL_RUN]] if not path else [[*plain(path), ALL_RUN]] if path[0] == "/" else []
            for steps in (plain(host), [RUN, *plain(f".{host}")]):
                patterns += [([*steps, *tail], (host + path, None, action)) for tail in tails]
        for action, glob in sorted(globs, key=lambda g: -sum(isinstance(s, frozenset) for s in glob_steps(g[1]))):
            steps = glob_steps(glob)
            patterns.append((steps, (None, glob, action)))
            if "/" not in glob and ALL_RUN not in steps:
                patterns.append(([*steps, *plain("/"), ALL_RUN], (None, glob, action)))
        if any(action not in ("allow", "block") for _, (_, _, action) in patterns):
            raise ValueError("a rule allows or blocks")
        self.verdicts = [v for _, v in patterns]
        named = sorted({SLASH}.union(*(s if isinstance(s, frozenset) else s[0] for steps, _ in patterns for s in steps if not isinstance(s, str))))
        self.classes = np.zeros(0x110000, np.uint16 if len(named) < 1 << 16 else np.uint32)  # 0: no pattern names it
        self.classes[named] = np.arange(1, len(named) + 1)
        of = {c: i + 1 for i, c in enumerate(named)}
        every = set(range(len(named) + 1))
        no_slash = every - {of[SLASH]}
        width = sum(1 + sum(not isinstance(s, str) for s in steps) for steps, _ in patterns)
        self.words = max(1, -(-width // 64))
        step, loop = (np.zeros((len(named) + 1, self.words), np.uint64) for _ in range(2))
        self.start, self.final, ends, bit = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64), [], 0
        put = lambda mask, at: mask.__setitem__(at // 64, mask[at // 64] | np.uint64(1 << at % 64))
        for steps, _ in patterns:
            put(self.start, bit)
            for s in steps:
                if isinstance(s, str):
                    for c in every if s == ALL_RUN else no_slash:
                        put(loop[c], bit)
                    continue
                bit += 1
                for c in {of[p] for p in s} if isinstance(s, frozenset) else no_slash - {of[p] for p in s[0]}:
                    put(step[c], bit)
            put(self.final, bit)
            ends.append(bit)
            bit += 1
        self.step, self.loop, self.ends = step, loop, np.array(ends, np.int64)

    def first(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first pattern that fits each url, or -1; ``codes`` are the urls' code points end to end, ``at`` their bounds."""
        out = np.full(len(at) - 1, -1, np.int64)
        order, block = np.argsort(at[:-1] - at[1:], kind="stable"), max(1, STATE_WORDS // self.words)
        for lo in range(0, len(order), block):
            mine = order[lo : lo + block]
            begin, size = at[mine], at[mine + 1] - at[mine]
            state = np.tile(self.start, (len(mine), 1))
            left = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")  # urls that have a character at each place
            for t, n in enumerate(left.tolist()):
                c = self.classes[codes[begin[:n] + t]]
                now = state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                moved &= self.step[c]
                moved |= now & self.loop[c]
                state[:n] = moved
            state &= self.final
            word = (state != 0).argmax(1)
            low = state[np.arange(len(mine)), word]
            hit = np.flatnonzero(low)
            low = low[hit] & (~low[hit] + np.uint64(1))
            out[mine[hit]] = np.searchsorted(self.ends, word[hit] * 64 + np.log2(low.astype(float)).astype(np.int64))
        return out


@lru_cache(maxsize=8)
def automaton(rules: tuple[Rule, ...], globs: tuple[Glob, ...]) -> UrlAutomaton:
    return UrlAutomaton(rules, globs)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    part = lambda group: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def decision(canonical: Column, rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS) -> Column:
    """struct(rule, pattern, verdict) of canonical URLs: the rule or the glob that decided, null where none did."""

    @F.arrow_udf("struct<rule:string,pattern:string,verdict:string>")
    def judge(urls: pa.Array) -> pa.Array:
        machine = automaton(rules, globs)
        texts = urls.to_pylist()
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=at[1:])
        first = machine.first(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at)
        said = [*machine.verdicts, (None, None, "allow")]
        return pa.StructArray.from_arrays([pa.array([v[k] for v in said], pa.string()).take(pa.array(first % len(said))) for k in range(3)], names=["rule", "pattern", "verdict"])

    return judge(canonical)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS, url: str = "url", into: str = "url_verdict") -> DataFrame:
    """``pages`` with one more column: struct(host, path, rule, pattern, verdict); if its name is taken, underscores come before it."""
    host, path = host_and_path(url)
    name = free_name(pages, into)
    return pages.withColumn(name, F.struct(host.alias("host"), path.alias("path"))).withColumn(
        name, F.struct(f"{name}.host", f"{name}.path", decision(F.concat(f"{name}.host", f"{name}.path"), rules, globs).alias("d"))
    ).withColumn(name, F.struct(f"{name}.host", f"{name}.path", f"{name}.d.rule", f"{name}.d.pattern", f"{name}.d.verdict"))


def allowed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS, url: str = "url") -> DataFrame:
    """The pages whose url is not blocked, with their own columns."""
    name = free_name(pages, "url_verdict")
    return judged(pages, rules, globs, url).filter(F.col(f"{name}.verdict") == "allow").select(pages.columns)


def url_digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, pattern (a glob) and verdict of each page."""
    return judged(pages.select("page_id", "url")).select("page_id", "url_verdict.*")


def _regex(glob: str) -> str:
    out = ""
    for s in glob_steps(glob):
        if isinstance(s, str):
            out += ".*" if s == ALL_RUN else "[^/]*"
        elif isinstance(s, tuple):
            out += "[^/" + "".join(f"\\x{{{p:x}}}" for p in sorted(s[0])) + "]"
        else:
            out += "[" + "".join(f"\\x{{{p:x}}}" for p in sorted(s)) + "]"
    return f"(?s){out}(/.*)?" if "/" not in glob and "**" not in glob else f"(?s){out}"


def url_oracle(rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS) -> str:
    """DuckDB's SQL for ``url_digest``: string functions for rules, regular expressions for globs."""
    rule_rows = ", ".join(f"({i}, '{a}', '{h}', '{p}')" for i, (a, h, p) in enumerate(rules))
    plain = [sum(isinstance(s, frozenset) for s in glob_steps(g)) for _, g in globs]
    glob_rows = ", ".join(f"({i}, {n}, '{a}', '{g}', '{_regex(g)}')" for i, (n, (a, g)) in enumerate(zip(plain, globs)))
    return rf"""
    WITH u AS (SELECT row_number() OVER () AS line, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    r AS (SELECT * FROM (VALUES {rule_rows}) t(i, action, h, p)), g AS (SELECT * FROM (VALUES {glob_rows}) t(i, n, action, pattern, regex)),
    x AS (SELECT line, h || p AS rule, action, row_number() OVER (PARTITION BY line ORDER BY length(h || p) DESC, length(h) DESC, i) AS k FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)),
    y AS (SELECT line, pattern, action, row_number() OVER (PARTITION BY line ORDER BY n DESC, i) AS k FROM u JOIN g ON regexp_full_match(host || path, regex))
    SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern, coalesce(x.action, y.action, 'allow') AS verdict
    FROM u LEFT JOIN x ON x.line = u.line AND x.k = 1 LEFT JOIN y ON y.line = u.line AND y.k = 1
    """
