"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. The
index has postings (trigram, document) for the trigrams of the rules; intersecting them per clause
gives candidates, which the regular expression verifies. Rules without a mandatory trigram scan all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_of


@dataclass(frozen=True)
class Rule:
    """kind; pattern (Java syntax); group and its least length that a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed. The least length of a match
#: that is one whole run can stand in its pattern, as no shorter part of the run can match then.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds found besides.
MORE = (
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH |DSA |)PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE


def _literals(pattern: str) -> list[list[str]]:
    """The pattern as a sequence of alternatives: each element lists the strings that its place can be.

    Reads literals, alternations of literals in a group, optional literals and small classes; anything else (classes,
    repeats, other groups) becomes an element that lists nothing, which breaks the run of literals.
    """
    out: list[list[str]] = []
    rest = re.sub(r"^\(\?i\)", "", pattern)
    while rest:
        if m := re.match(r"\(((?:[\w -]|\?(?!:))*(?:\|(?:[\w -]|\?)*)+)\)", rest):
            out.append([x for part in m[1].split("|") for x in _optional(part)])
        elif m := re.match(r"\[[^\]]*\]|\\x[0-9A-Fa-f]{2}|\\.|[^\[\\]", rest):
            item = m[0]
            if re.fullmatch(r"\[\w{1,8}\]", item):  # a small class without ranges
                out.append(list(item[1:-1]))
                item = ""
            single = item[1:] if re.fullmatch(r"\\[.\-/]", item) else item if re.fullmatch(r"[\w -]", item) else ""
            if item:
                out.append([single] if single else [])
        rest = rest[m.end() :]
        if q := re.match(r"[*?+]|\{[\d,]+\}", rest):
            rest = rest[q.end() :]
            if q[0] == "+" and out[-1]:
                out.append([])
            elif q[0] != "+":
                out[-1] = []
    return out


def _optional(literal: str) -> list[str]:
    """Both readings of each optional character of a literal."""
    parts = re.findall(r"(.)(\?)?", literal)
    return ["".join(x) for x in product(*[(c, "") if q else (c,) for c, q in parts])]


def trigram_query(pattern: str, fold: bool) -> list[frozenset[str]]:
    """The clauses of a rule: a match's text has all trigrams of one clause at least; empty: scan all.

    Adjacent literal elements join to all strings that they can form; the run of literals whose
    weakest string has the most trigrams is the query.
    """
    runs: list[list[str]] = [[""]]
    for choices in _literals(pattern):
        runs[-1:] = [[a + b for a in runs[-1] for b in choices]] if choices else [runs[-1], [""]]
    lower = (lambda x: x.lower()) if fold else (lambda x: x)
    clauses = [[frozenset(lower(s[i : i + 3]) for i in range(len(s) - 2)) for s in run] for run in runs]
    best = max(clauses, key=lambda c: min(map(len, c)))
    return sorted(set(best), key=sorted) if min(map(len, best)) else []


def queries_of(rules: Sequence[Rule]) -> dict[str, list[frozenset[str]]]:
    """Each kind's clauses; trigrams are of lower-cased text, as one index serves all rules."""
    return {r.kind: trigram_query(r.pattern, True) for r in rules}


def indexed(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """docs with __grams, the rules' trigrams that each text has, found in one pass over the text."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    any_of = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))
    return docs.withColumn("__grams", F.array_distinct(F.regexp_extract_all("__low", F.lit(f"(?=({any_of}))"), F.lit(1))))


def postings(index: DataFrame) -> DataFrame:
    """(trigram, __k1, __k2): the documents that have a trigram; nothing of their texts is in a posting."""
    return index.select("__k1", "__k2", F.explode("__grams").alias("trigram"))


def intersect(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(__k1, __k2, __kinds): the documents that have all trigrams of a clause of some kind, and these kinds.

    The postings of a document set a flag for each trigram, and a clause holds where all its flags
    are set. Flags are combined before they are shuffled, and keys are documents, so the postings of
    a frequent trigram do not meet in a task.
    """
    clauses = [(k, c) for k, cs in queries.items() for c in cs]
    has = {t: F.max(F.col("trigram") == t) for t in sorted({t for _, c in clauses for t in c})}
    names = {t: f"t{i}" for i, t in enumerate(has)}
    grouped = index.groupBy("__k1", "__k2").agg(*[e.alias(names[t]) for t, e in has.items()])
    found = [F.when(reduce(Column.__or__, [reduce(Column.__and__, [F.col(names[t]) for t in c]) for c in cs]), F.lit(k)) for k, cs in queries.items() if cs]
    kinds = F.filter(F.array(*found), lambda k: k.isNotNull())
    return grouped.select("__k1", "__k2", kinds.alias("__kinds")).where(F.size("__kinds") > 0)


#: Elements that are folded into one list at once: lists of lists keep running values linear.
FOLD = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of whole numbers (0 or more), the sum or maximum (join) of those before it; 0 for the first.

    Values are folded in parts of FOLD, and the parts' results likewise, so a long array takes no
    time with the square of its length, as appending to one list does.
    """
    empty = F.array().cast("array<long>")

    def fold(part: Column) -> Column:
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list"))
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("list")), step)

    def whole(parts: Column) -> Column:
        bases = fold(F.transform(parts, lambda p: p["at"]))["list"]
        rows = F.arrays_zip(parts.alias("part"), bases.alias("base"))
        return F.flatten(F.transform(rows, lambda r: F.transform(r["part"]["list"], lambda x: join(r["base"], x))))

    n = F.size(values)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(FOLD)), lambda i: fold(F.slice(values, i + 1, FOLD)))
    return F.when(n > 0, _bound(parts, whole)).otherwise(empty)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's leftmost non-overlapping matches that are long enough, in code points.

    The pieces between matches and the matches' own lengths, summed up, give the places.
    """
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda x: F.length(x).cast("long"))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    rows = F.arrays_zip(gaps.alias("gap"), lengths(0).alias("whole"), *[lengths(rule.group).alias("part")] * (rule.group > 0))

    def placed(rows: Column) -> Column:
        before = running(F.transform(rows, lambda r: r["gap"] + r["whole"]), Column.__add__)
        return F.transform(F.arrays_zip(rows.alias("r"), before.alias("at")), lambda x: F.struct((x["at"] + x["r"]["gap"]).alias("start"), (x["at"] + x["r"]["gap"] + x["r"]["whole"]).alias("end"), x["r"]["part" if rule.group else "whole"].alias("n")))

    # The last piece has no match after it.
    found = _bound(F.filter(rows, lambda r: r["whole"].isNotNull()), placed)
    spans = F.transform(F.filter(found, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with a column spans: array<struct<start, rank, kind, end>> by start, then kind as listed.

    Null texts count as empty; equal rows each get their spans; an empty table gives none. Other
    columns of docs stay as they are (names that begin with two underscores are for the operator).
    Documents with a trigram that some clause needs are written with their postings once; these and
    no others are shuffled with their texts, to meet the candidates.
    """
    queries = queries_of(rules)
    trigrams = sorted({t for cs in queries.values() for c in cs for t in c})
    text = text_of("text")
    keyed = docs.withColumns({"__low": F.lower(text), "__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "doc_id", "text")})
    any_posting = reduce(Column.__or__, [F.contains("__low", F.lit(t)) for t in _covers(queries)], F.lit(False))
    index = save(indexed(keyed.where(any_posting), trigrams).drop("__low"))
    candidates = intersect(postings(index), queries).select(F.col("__k1").alias("__c1"), F.col("__k2").alias("__c2"), "__kinds")
    some = index.drop("__grams")
    some = some.join(candidates, (some["__k1"] == candidates["__c1"]) & (some["__k2"] == candidates["__c2"]), "left").drop("__c1", "__c2")
    none = keyed.where(~any_posting).drop("__low").withColumn("__kinds", F.lit(None).cast("array<string>"))
    rows = some.unionByName(none)
    found = []
    for rank, rule in enumerate(rules):
        own = F.transform(spans_of(text, rule), _named(rank, rule.kind))
        if queries[rule.kind]:
            own = F.when(F.array_contains("__kinds", rule.kind), own)
        found.append(F.coalesce(own, F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    return rows.withColumn("spans", F.array_sort(F.concat(*found))).select(*docs.columns, "spans")


def _covers(queries: dict[str, list[frozenset[str]]]) -> list[str]:
    """Trigrams of which any clause has one: without any of these, no clause can hold.

    Chosen one by one: that which most of the clauses left have, of these the last in order.
    """
    left, out = [c for cs in queries.values() for c in cs], []
    while left:
        out.append(max((t for c in left for t in c), key=lambda t: (sum(t in c for c in left), t)))
        left = [c for c in left if out[-1] not in c]
    return sorted(out)


def _named(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of spans of every document (see scan)."""
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    n = {f"n_{r.kind}": F.size(F.filter("spans", _of_kind(r.kind))).cast("long") for r in BASE}
    return scan(docs.select("doc_id", "text")).select("doc_id", *[e.alias(k) for k, e in n.items()], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


#: Code points of the parts of a text that is cut at spans.
PART = 1024


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in parts of PART: only the parts that hold them are joined."""
    first = F.floor(start / PART).cast("int")
    last = F.floor((F.greatest(end, start + 1) - 1) / PART).cast("int")
    own = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(own, (start - first * PART + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret's characters replaced by [kind]; overlapping spans become one, of the first one's kind.

    All rows stay, texts without secrets (and null ones) as they are; n_chars, if docs has it, follows.
    Equal rows are redacted alike; an empty table gives none.
    """
    hold = "__spans" if "spans" in docs.columns else None
    found = scan(docs.withColumnRenamed("spans", hold) if hold else docs)

    def cut(parts: Column) -> Column:
        ends = F.transform("spans", lambda x: x["end"].cast("long"))
        rows = F.arrays_zip(F.col("spans").alias("span"), running(ends, F.greatest).alias("at"))
        piece = lambda r: F.concat(_between(parts, r["at"], r["span"]["start"].cast("long")), F.lit("["), r["span"]["kind"], F.lit("]"))
        kept = F.transform(F.filter(rows, lambda r: r["span"]["start"] >= r["at"]), piece)
        return F.concat(F.array_join(kept, ""), _between(parts, F.array_max(ends), F.length("text").cast("long")))

    clean = _bound(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), cut)
    out = found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return (out.withColumnRenamed(hold, "spans") if hold else out).select(*docs.columns)
