"""Secrets in texts, found over a trigram index.

Each rule has a Boolean trigram query, derived from its regular expression: an OR of alternatives, each an AND of the
trigrams (lower-cased) that every match of the alternative must hold. The index lists, for each trigram that some query asks
for, the texts that hold it. Intersecting its postings by the queries gives the candidates of each rule, and only they are
verified with the expression. A rule without mandatory trigrams scans every text.

All of it is DataFrame functions. Places are code points: a text is split at the matches, and the lengths of the pieces add
up to the places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.binding import let
from pagewright.plans.workspace import Workspace


@dataclass(frozen=True)
class Rule:
    """kind, expression (Java syntax); group and least: a match counts if that group has so many characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base rules, fixed values. For `access` and `hex` the least length stands in the expression: their matches are whole runs,
#: and a run that is too short holds no match at a later place either.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Rules added to the base, fixed formats of public issuers.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

#: Values of an array that are run through at a time.
BLOCK = 256
#: Candidate rows that may be broadcast.
MOST_BROADCAST = 200_000
#: Alternatives longer than this are cut back to the literals found so far: the query gets weaker, never wrong.
_MOST_STRINGS = 32


def _expand(pattern: str) -> list[list[str]]:
    """Ways to match, each a list of literal strings that must all occur (lower-cased): a small cross-product parser.

    It knows literals, escapes, small classes, groups, alternatives and the quantifiers; whatever else it meets, or a class of
    more than six characters, ends the running literal. An optional item yields the ways with and without it.
    """
    pos = 0

    def alternatives(depth: int) -> list[list[str]]:
        nonlocal pos
        ways = sequence(depth)
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            ways += sequence(depth)
        return ways

    def join(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
        """Last literal of the left and first of the right touch; '' parts literals."""
        out = [a[:-1] + [a[-1] + b[0]] + b[1:] for a in left for b in right]
        return out if len(out) <= _MOST_STRINGS else [a + [""] for a in left] if len(left) <= _MOST_STRINGS else [[""]]

    def sequence(depth: int) -> list[list[str]]:
        nonlocal pos
        ways = [[""]]
        while pos < len(pattern) and pattern[pos] not in "|)":
            item = atom(depth)
            low, exact = quantifier()
            if low == 0:
                item = (item + [[""]]) if exact == 1 else [["", ""]]
            elif exact != low or low > 1:
                item = [w + [""] for w in item]
            ways = join(ways, item)
        return ways

    def quantifier() -> tuple[int, int | None]:
        nonlocal pos
        rest = pattern[pos:]
        for sign, bounds in (("?", (0, 1)), ("*", (0, None)), ("+", (1, None))):
            if rest.startswith(sign):
                pos += 1
                return bounds
        if m := re.match(r"\{(\d+)(,?)(\d*)\}", rest):
            pos += m.end()
            return int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
        return 1, 1

    def atom(depth: int) -> list[list[str]]:
        nonlocal pos
        ch = pattern[pos]
        pos += 1
        if ch == "(":
            if m := re.match(r"\?[a-z]*:", pattern[pos:]):
                pos += m.end()
            ways = alternatives(depth + 1)
            pos += 1
            return ways
        if ch == "[":
            body = re.match(r"\^?\]?(?:\\.|[^\]\\])*\]", pattern[pos:])[0]
            pos += len(body)
            chars = re.sub(r"\\(.)", r"\1", body[:-1])
            few = "" if body.startswith("^") or re.search(r".-.", chars) or len(chars) > 6 else chars
            return [[c.lower()] for c in few] or [["", ""]]
        if ch == "\\":
            if m := re.match(r"x([0-9A-Fa-f]{2})", pattern[pos:]):
                pos += 3
                return [[chr(int(m[1], 16)).lower()]]
            pos += 1
            return [["", ""]] if pattern[pos - 1].isalpha() else [[pattern[pos - 1]]]
        return [["", ""]] if ch in ".^$" else [[ch.lower()]]

    return alternatives(0)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of trigrams; None if some way to match has no trigram: the rule has to scan everything."""
    clauses = set()
    for way in _expand(pattern):
        grams = frozenset(s[i : i + 3] for s in way for i in range(len(s) - 2))
        if not grams:
            return None
        clauses.add(grams)
    # a clause that holds another one's trigrams asks for more than is needed beside it
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _any_of(grams: list[str]) -> str:
    """An expression that finds the next of some trigrams, written as a tree of their characters; matches may overlap."""
    one = lambda c: re.escape(c) if not c.isalnum() else c
    tree: dict[str, dict[str, str]] = {}
    for g in grams:
        tree.setdefault(g[0], {}).setdefault(g[1], "")
        tree[g[0]][g[1]] += g[2]
    ways = [one(a) + "(?:" + "|".join(one(b) + "[" + "".join(map(re.escape, last)) + "]" for b, last in sorted(rest.items())) + ")" for a, rest in sorted(tree.items())]
    return "(?=[" + "".join(map(re.escape, sorted(tree))) + "])(?=(" + "|".join(ways) + "))"


def index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, key) of the texts (key, text): of those trigrams only that some query asks for. A text is cut into them
    in one pass."""
    # letters beyond ASCII whose lower case is ASCII can only add candidates
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(grams)), 1))
    return texts.select(F.explode(held).alias("gram"), "key")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): the rules whose query a text meets. The queries are a few rows, fixed by the rules."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("clause"), F.lit(g).alias("gram"), F.lit(len(clause)).alias("needed")) for kind, clauses in queries.items() for i, clause in enumerate(clauses) for g in sorted(clause)]
    asked = postings.sparkSession.range(1).select(F.inline(F.array(*rows)))
    met = postings.join(F.broadcast(asked), "gram").groupBy("key", "kind", "clause").agg(F.count_distinct("gram").alias("n"), F.first("needed").alias("needed")).filter("n = needed")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def running(values: Column, op, zero: Column) -> Column:
    """op over each prefix of an array of integers. Blocks of BLOCK are run through one by one, so the arrays that grow by
    appending stay short."""

    def along(array: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            at = op(acc["at"], x)
            return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

        return F.aggregate(array, first, add)["out"]

    n = F.size(values)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    def joined(parts: Column) -> Column:
        ends = along(F.transform(parts, lambda p: F.aggregate(p, zero, op)), zero)
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: along(p, F.when(k > 0, F.get(e, k - 1)).otherwise(zero)))))

    return let(blocks, joined)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (begin, end) of a rule's matches, leftmost first, none overlapping, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, pattern, 0), F.length)
    counted = lengths if not rule.group else F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length)
    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(lengths)).alias("gap"), lengths.alias("n"), counted.alias("counted"))

    def placed(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: x["gap"] + x["n"]), lambda a, x: a + x, F.lit(0))
        return F.zip_with(m, ends, lambda x, end: F.struct((end - x["n"]).alias("begin"), end.alias("end"), x["counted"].alias("counted")))

    return F.transform(F.filter(let(matches, placed), lambda m: m["counted"] >= rule.least), lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end")))


def _of_rule(text: Column, rank: int, rule: Rule, base: bool, indexed: bool) -> Column:
    """A rule's spans in a candidate text (in any text if the rule is not indexed), none elsewhere."""
    maybe = F.rlike(text, F.lit(rule.pattern))
    if indexed:
        maybe = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)) & maybe  # null would not spare the expression
    own = F.when(maybe, spans(text, rule)).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))
    return F.transform(own, lambda s: F.struct(s["begin"].alias("begin"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base")))


def scan(docs: DataFrame, ws: Workspace, base: list[Rule] | None = None, more: list[Rule] | None = None) -> DataFrame:
    """row (all columns of docs, whatever their names), doc_id, text, found: array of (begin, rank, kind, end, base) in order of
    place, then of the rules' list.

    docs hold doc_id and text. Matches of a rule do not overlap each other, those of different rules may. Places are code
    points, end exclusive. Null and empty texts hold none. Repeated rows and null ids are scanned like any other. No rows, no
    result.
    """
    rules = [(r, True) for r in (BASE if base is None else base)] + [(r, False) for r in (MORE if more is None else more)]
    queries = {r.kind: trigram_query(r.pattern) for r, _ in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", F.xxhash64(text, F.length(text)).alias("__key"))
    grams = sorted({g for q in indexed.values() for c in q for g in c})
    postings = index(marked.select(F.col("__key").alias("key"), text.alias("text")), grams)
    hits = ws.save(candidates(postings, indexed).select(F.col("key").alias("__key"), F.col("kinds").alias("__kinds")), "candidates")
    # candidates are few; where they are not, texts are shuffled once to meet them
    joined = marked.join(F.broadcast(hits) if hits.count() <= MOST_BROADCAST else hits, "__key", "left")
    found = [_of_rule(text, rank, rule, is_base, rule.kind in indexed) for rank, (rule, is_base) in enumerate(rules)]
    return joined.select("row", "doc_id", "text", F.sort_array(F.concat(*found)).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def mask(text: Column, found: Column, sign: str = "[SECRET]") -> Column:
    """The text with each span of secrets, overlapping ones as one, replaced by a sign. found: sorted by begin."""

    def cut(spans_: Column, reach: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            return F.when(s["begin"] >= at, F.concat(text.substr(at + 1, s["begin"] - at), F.lit(sign))).otherwise("")

        return F.concat(F.array_join(F.transform(spans_, piece), ""), text.substr(F.get(reach, F.size(reach) - 1) + 1, F.length(text)))

    reach = running(F.transform(found, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    return F.when(F.size(found) == 0, text).otherwise(let(reach, lambda r: cut(found, r)))


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whatever their names, secrets in their texts replaced by a sign and n_chars (if there is
    one) counted anew."""
    masked = scan(docs, Workspace(spark, "secrets-stage")).withColumn("text", mask(F.col("text"), F.col("found")))
    of = lambda c: F.col("row")[c]
    counted = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted["n_chars"] = F.when(F.size("found") > 0, F.length("text")).otherwise(of("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.select(*(counted.get(c, of(c)).alias(c) for c in docs.columns))
