"""Secret scans by a trigram index, in DataFrame operations only.

Each rule's regex is analysed on the driver: which trigrams must a text contain to
match at all? The answer is an OR of ANDs. The index holds, for the trigrams that rules ask
for, the documents that contain them (letters in lower case). A clause's postings are
intersected by counting, and only the candidates are searched with the regex. A rule
without mandatory trigrams searches every text.

* null texts are read as empty; an empty text has no span and the digest of ""
* every row is scanned whole, repeated rows each; null ids are kept
* positions are code points, ends exclusive; other columns are ignored
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import free_name

#: Exact strings an analysis keeps before it turns them into trigrams.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must be ``least`` at least; others are dropped."""

    kind: str
    regex: str
    value: int = 0
    least: int = 0
    base: bool = False


#: The rules in the order in which spans with the same start are listed.
#: The patterns of the base rules and of well-known token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

# A report names the key's first line, as the comparison SQL does; what is hidden runs on to the
# END line, or, where that is missing or another key begins before it, to the end of the key's lines.
_SEPARATOR = r"""(?:[\s"'+,>#*|]|\\[nr])"""
# Possessive repeats are matched in a loop, whatever the number of lines.
_HEADERS = rf"(?:{_SEPARATOR}{{1,40}}[A-Za-z]{{1,20}}(?:-[A-Za-z]{{1,20}})?:\x20[^\n\\]*+)*+"
_KEY_LINES = rf"{_HEADERS}(?:{_SEPARATOR}{{0,40}}[A-Za-z0-9+/=_]{{16,}})++(?:{_SEPARATOR}{{1,40}}[A-Za-z0-9+/]{{1,75}}={{0,2}}(?=\s*(?:\n|$|-----)|\\|[\"']))?"
_TO_END = r"[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-{5,}END [A-Z ]*PRIVATE KEY-----"
HIDDEN = tuple(
    replace(rule, regex=rf"{rule.regex}(?:{_TO_END}|{_KEY_LINES})?") if rule.kind == "private_key" else rule for rule in RULES
)


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams, of which a match contains at least one whole clause.

    An empty list means that the regex has no mandatory trigram.
    """
    tree = parser.parse(regex.replace("(?-i)", ""), re.ASCII)
    best: list[frozenset[str]] = []
    strings = {""}

    def close() -> None:
        nonlocal strings, best
        clauses = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(clauses):
            clauses = sorted({c for c in clauses if not any(o < c for o in clauses)}, key=sorted)
            best = [a | b for a, b in product(best, clauses)] if best else clauses
        strings = {""}

    def walk(items) -> None:
        nonlocal strings
        for item in items:
            exact = _strings(item)
            joined = {a + b for a in strings for b in exact} if exact else set()
            if exact and len(joined) <= MOST_STRINGS:
                strings = joined
            else:
                close()
                if exact and len(exact) <= MOST_STRINGS:
                    strings = exact
                elif item[0] is op.SUBPATTERN:
                    walk(item[1][-1])
                    close()
                elif item[0] is op.MAX_REPEAT and item[1][0] > 0:
                    walk(item[1][2])
                    close()

    walk(tree)
    close()
    return best


def _strings(item) -> set[str] | None:
    """All strings that a part of a regex matches, in lower case, if they are few."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        out = set()
        for what, x in value:
            if what is op.LITERAL:
                out.add(chr(x).lower())
            elif what is op.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 3:
        part = _sequence(value[2])
        if part is None:
            return None
        return {"".join(x) for n in range(value[0], value[1] + 1) for x in product(part, repeat=n)}
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        part = _strings(item)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_index(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """Postings ``(trigram, key)`` of the trigrams asked for, each document once."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(F.col("_low").contains(t), F.lit(t)) for t in trigrams)))
    return docs.select(key, low.alias("_low")).select(key, F.explode(found).alias("trigram")).distinct()


def candidates(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``key`` and the kinds whose trigram query a document satisfies."""
    clauses = [
        (rule.kind, number, trigram, len(clause))
        for rule in rules
        for number, clause in enumerate(trigram_query(rule.regex))
        for trigram in sorted(clause)
    ]
    spark = docs.sparkSession
    asked = spark.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    postings = trigram_index(docs, key, text, sorted({c[2] for c in clauses}))
    # the clauses are as many as the rules make them, not the documents
    met = postings.join(F.broadcast(asked), "trigram").groupBy(key, "kind", "clause").agg(
        F.count(F.lit(1)).alias("n"), F.first("size").alias("size")
    )
    return met.where("n = size").groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in a text, leftmost first, as structs of start, order, kind, end.

    ``\\G`` makes each match begin where the last one ended, so the text between is
    read once; lengths of gaps and matches add up to positions.
    """
    regex = rf"\G([\s\S]*?)({rule.regex})"
    gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(2))
    values = F.regexp_extract_all(text, F.lit(regex), F.lit(2 + rule.value))
    rows = F.zip_with(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))), values,
        lambda x, v: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.length(v).alias("v")),
    )

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["g"]
        stop = start + row["h"]
        here = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        kept = F.when(row["v"] >= rule.least, F.concat(acc["found"], here)).otherwise(acc["found"])
        return F.struct(stop.alias("at"), kept.alias("found"))

    def of_piece(piece: Column) -> Column:
        return F.aggregate(piece["items"], F.struct(piece["at"].alias("at"), F.array().cast(_SPANS).alias("found")), step)["found"]

    return F.flatten(F.transform(_pieces(rows, lambda x: (x["g"] + x["h"]).cast("bigint"), lambda a, b: a + b), of_piece))


_SPANS = "array<struct<start:bigint,ord:int,kind:string,stop:bigint>>"
#: Hits of a text that are handled together: an array or text that grows is copied at each step.
PIECE = 512


def _pieces(items: Column, measure, join) -> Column:
    """``items`` in pieces of ``PIECE``, as structs of ``items``, ``at`` and ``to``.

    ``to`` joins the measures of all items up to the piece's end, starting at 0; ``at`` those before
    it. A text with very many hits takes time by their number, not its square.
    """
    # named within a lambda, the items are made once, not for each piece
    return F.transform(F.array(items), lambda held: _pieces_of(held, measure, join))[0]


def _pieces_of(items: Column, measure, join) -> Column:
    zero = F.lit(0).cast("bigint")
    cut = F.when(F.size(items) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")), lambda k: F.slice(items, k * PIECE + 1, F.lit(PIECE))
    )).otherwise(F.array())
    none = F.slice(F.transform(F.array(F.lit(0)), lambda _: F.struct(items.alias("items"), zero.alias("at"), zero.alias("to"))), 1, F.lit(0))

    def add(acc: Column, piece: Column) -> Column:
        to = join(acc["to"], F.aggregate(piece, zero, lambda total, x: join(total, measure(x))))
        return F.struct(to.alias("to"), F.concat(acc["done"], F.array(F.struct(piece.alias("items"), acc["to"].alias("at"), to.alias("to")))).alias("done"))

    return F.aggregate(cut, F.struct(zero.alias("to"), none.alias("done")), add)["done"]


def long_runs(text: Column, rule: Rule, order: int) -> Column:
    """Like :func:`spans` for a rule that is one run of characters: only long runs are taken."""
    return spans(text, Rule(rule.kind, rule.regex.removesuffix("+") + f"{{{rule.least},}}"), order)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), found: str = "found") -> DataFrame:
    """Every row of ``docs`` with its columns ``keep``, ``text`` and ``found``, its sorted spans."""
    key, its_kinds = free_name(docs, "__key"), free_name(docs, "__kinds")
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(*keep, text, F.xxhash64("doc_id", "text").alias(key))
    indexed = tuple(r for r in rules if trigram_query(r.regex))
    kinds = candidates(rows.select(key, "text"), key, "text", indexed).withColumnRenamed("kinds", its_kinds)
    joined = rows.join(kinds, key, "left").drop(key)
    empty = F.array().cast("array<struct<start:bigint,ord:int,kind:string,stop:bigint>>")
    parts = []
    for order, rule in enumerate(rules):
        if rule in indexed:
            hit = F.coalesce(F.array_contains(its_kinds, rule.kind), F.lit(False))
            parts.append(F.when(hit, spans(F.col("text"), rule, order)).otherwise(empty))
        else:
            run = re.fullmatch(r"\[[^\]]+\]\+", rule.regex)
            parts.append((long_runs if run else spans)(F.col("text"), rule, order))
    return joined.select(*keep, "text", F.array_sort(F.concat(*parts)).alias(found))


def digest(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans, of every row."""
    base = [r.kind for r in rules if r.base]
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    return scan(docs, rules).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(digest(F.filter(found, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        digest(found).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = HIDDEN, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mark``; overlapping spans count as one."""
    names, found = docs.columns, free_name(docs, "__found")
    scanned = scan(docs, rules, tuple(n for n in names if n != "text"), found)
    text, pieces = F.col("text"), free_name(docs, "__pieces")

    def cut(piece: Column) -> Column:
        """The text of a piece, from the end of the one before, with its spans replaced."""
        own = F.struct(
            piece["items"].alias("items"), piece["at"].alias("at"),
            F.substring(text, (piece["at"] + 1).cast("int"), (piece["to"] - piece["at"]).cast("int")).alias("text"),
        )
        return F.transform(F.array(own), lambda p: F.aggregate(
            p["items"], F.struct(p["at"].alias("at"), F.lit("").alias("out")), lambda acc, x: step(p, acc, x)
        )["out"])[0]

    def step(piece: Column, acc: Column, x: Column) -> Column:
        place, size = acc["at"] - piece["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))
        gap = F.substring(piece["text"], place.cast("int"), size.cast("int"))
        added = F.when(x["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], added).alias("out"))

    out = scanned.withColumn(pieces, _pieces(F.col(found), lambda x: x["stop"], F.greatest))
    rest = F.substring(text, (F.array_max(F.transform(pieces, lambda p: p["to"])) + 1).cast("int"), F.length("text"))
    text = F.when(F.size(found) > 0, F.concat(F.array_join(F.transform(pieces, cut), ""), rest)).otherwise(text)
    return out.select(*(text.alias("text") if n == "text" else F.col(n) for n in names))
