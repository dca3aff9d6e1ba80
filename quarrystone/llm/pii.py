"""Personal data by patterns, checksums and context, in Spark's own functions only.

Regular expressions propose spans; Luhn, mod-97 and range checks confirm them;
words near a span move its score.  Base kinds that pass their checks always
stay; the kinds added here (IBAN, social security number) stay from MIN_SCORE on.
Positions are code points: a pattern's matches alternate with the text between
them, so running lengths give both ends.  A text with spans is cut into blocks once, and
what lies around or between spans is read from its block: the work grows with text and
spans (times a logarithm for the running sums), not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns in listed order.  Possessive repeats and the look-behinds
# keep the leftmost matches and make a failed start cost no second scan of the same run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added kinds: account numbers with two check digits, and numbers that context must support.
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Characters that may not stand next to a span of an added kind.
TOUCH = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
BASE = ("email", "ip", "card", "phone")
#: What a text needs for the kind to be looked for at all: a cheap test before the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}

#: Code points before and after a span in which words count, those words, and what they add.
NEAR = 40
WORDS = {"email": "mail|contact|write", "ip": "address|host|server", "card": "card|visa|master|amex|credit|pay", "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social|security"}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
CONTEXT, MIN_SCORE = 0.2, 0.6


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit is doubled, digit sums add up to tens."""
    n = F.length(number)

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(number, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(k % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number's check digits hold: first four characters last, letters as 10 to 35, modulo 97 one."""
    s = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(acc: Column, k: Column) -> Column:
        c = F.substring(s, k, F.lit(1))
        v = F.ascii(c)
        return F.when(c.rlike("[0-9]"), (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def at_most_255(number: Column) -> Column:
    """Of a string of digits, however long: three digits compare as text."""
    n = F.ltrim(number, F.lit("0"))
    return (F.length(n) < 3) | (F.length(n) == 3) & (n <= "255")


def confirmed(kind: str, m: Column) -> Column:
    """Whether a proposed match passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), at_most_255)
    if kind == "card":
        d = digits(m)
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        s = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(s).between(15, 34) & F.when(F.length(s).between(15, 34), mod97(s)).otherwise(False)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


SPAN = "array<struct<start: bigint, k: int, kind: string, end: bigint, score: double>>"
#: Code points of a block of text.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each prefix of an array of longs the combination of its values, by doubling."""
    strides = F.array(*(F.lit(1 << k) for k in range(31)))

    def double(acc: Column, s: Column) -> Column:
        return F.transform(acc, lambda v, i: F.when(i >= s, combine(v, F.get(acc, i - s))).otherwise(v))

    return let(values, lambda all_: F.aggregate(F.filter(strides, lambda s: s < F.size(all_)), all_, double))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text in blocks; what lies beyond it is empty."""

    def part(k: Column) -> Column:
        at = F.greatest(start - k * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), (at + 1).cast("int"), (F.least(end - k * BLOCK, F.lit(BLOCK)) - at).cast("int"))

    touched = F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
    return F.when(end > start, F.array_join(F.transform(touched, part), "")).otherwise("")


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: start, rank of the kind, kind, end (exclusive), score."""
    pattern, k = PATTERNS[kind], [*PATTERNS].index(kind)
    none = F.array().cast(SPAN)

    def placed(hits: Column, gaps: Column) -> Column:
        sizes = F.transform(F.slice(gaps, F.lit(1), F.size(hits)), lambda g, i: (F.char_length(g) + F.coalesce(F.char_length(F.get(hits, i - 1)), F.lit(0))).cast("long"))
        starts = running(sizes, lambda a, b: a + b)
        both = F.transform(F.arrays_zip(starts.alias("start"), hits.alias("hit")), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["hit"])).alias("end"), x["hit"].alias("hit")))
        return F.filter(both, lambda x: confirmed(kind, x["hit"]))

    def scored(found: Column, blocks: Column) -> Column:
        def one(x: Column) -> Column:
            before, after = cut(blocks, F.greatest(x["start"] - NEAR, F.lit(0)), x["start"]), cut(blocks, x["end"], x["end"] + NEAR)
            near = F.lower(F.concat(before, F.lit(" "), after)).rlike(WORDS[kind])
            score = F.lit(SCORE[kind]) + F.when(near, CONTEXT).otherwise(0.0)
            if kind in TOUCH:
                score = F.when(F.concat(F.right(before, F.lit(1)), F.left(after, F.lit(1))).rlike(TOUCH[kind]), 0.0).otherwise(score)
            return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end"), score.alias("score"))

        out = F.transform(found, one)
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= MIN_SCORE - 1e-9)

    def from_hits(hits: Column) -> Column:
        found = let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))
        return F.when(F.size(hits) > 0, let(found, lambda x: F.when(F.size(x) > 0, let(blocks_of(text), lambda b: scored(x, b))).otherwise(none))).otherwise(none)

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_hits)
    return F.when(text.contains(NEEDS[kind]), out).otherwise(none) if NEEDS[kind] else out


def with_spans(documents: DataFrame, text: str = "text", column: str = "pii") -> DataFrame:
    """``documents`` with an array of spans ordered by start, then kind; a column of that name is replaced.

    Null and empty texts have none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumn(column, F.array_sort(F.concat(*(spans_of(t, kind) for kind in PATTERNS))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for each row; scores in percent, in the order of spans."""
    found = with_spans(documents.select("doc_id", "text"), column="__pii").select("doc_id", "__pii")
    base = F.filter("__pii", lambda s: s["k"] < len(BASE))
    count = [F.size(F.filter("__pii", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("__pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__pii")).alias("spans"), scores.alias("scores"))


def redacted(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with each span replaced by its kind in angle brackets; spans that overlap go as one, named by the first.

    All rows and other columns stay; a null text stays null.  A column n_chars follows the text.
    """
    found = with_spans(documents, text, "__pii")
    t, spans = F.coalesce(F.col(text), F.lit("")), F.col("__pii")

    def rest(blocks: Column, reach: Column) -> Column:
        """Text before each span that begins after all before it have ended, its kind, and the text after the last."""
        before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(reach, i - 1))
        first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= before(i))
        parts = F.transform(first, lambda i: F.concat(cut(blocks, before(i), F.get(spans, i)["start"]), F.lit("<"), F.upper(F.get(spans, i)["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.get(reach, F.size(spans) - 1), F.char_length(t)))

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    new = let(F.struct(blocks_of(t).alias("blocks"), reach.alias("reach")), lambda x: rest(x["blocks"], x["reach"]))
    done = found.withColumn("__new", F.when(F.size(spans) > 0, new).otherwise(F.col(text)))
    kind = documents.schema
    return done.select(*(F.col("__new").alias(c) if c == text else F.length("__new").cast(kind[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns))


def oracle_sql() -> str:
    """The digests of every row of ``documents`` in DuckDB's SQL."""
    rules = {  # the base patterns without possessive repeats and look-behinds, which this engine neither has nor needs
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": PHONE,
        "iban": IBAN,
        "ssn": SSN,
    }
    code = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    ok = {
        "email": "true",
        "ip": "len([p for p in string_split(m, '.') if length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255']) = 0",
        "card": "length(d) BETWEEN 12 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN CAST(reverse(d)[k] AS INTEGER) ELSE CAST(reverse(d)[k] AS INTEGER) * 2 - CASE WHEN CAST(reverse(d)[k] AS INTEGER) > 4 THEN 9 ELSE 0 END END for k in range(1, length(d) + 1)]) % 10 = 0",
        "phone": "length(d) BETWEEN 9 AND 15",
        "iban": f"length(w) BETWEEN 15 AND 34 AND list_reduce([0] || [{code} for c in string_split(substr(w, 5) || substr(w, 1, 4), '')], lambda acc, x: (acc * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1 AND NOT regexp_matches(beside, '{TOUCH['iban']}')",
        "ssn": f"NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-|-0000$') AND NOT regexp_matches(beside, '{TOUCH['ssn']}') AND regexp_matches(around, '{WORDS['ssn']}')",
    }
    parts = []
    for n, (kind, rule) in enumerate(rules.items()):
        parts.append(f"""
SELECT *, CAST({round(SCORE[kind] * 100)} + CASE WHEN regexp_matches(around, '{WORDS[kind]}') THEN {round(CONTEXT * 100)} ELSE 0 END AS VARCHAR) AS score FROM (SELECT doc_id, {n} AS k, '{kind}' AS kind, a, a + length(m) AS e, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS w,
  CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END || substr(t, a + length(m) + 1, 1) AS beside, lower(substr(t, greatest(a - {NEAR}, 0) + 1, least(a, {NEAR})) || ' ' || substr(t, a + length(m) + 1, {NEAR})) AS around
  FROM (SELECT doc_id, t, ms[i] AS m, CAST(list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS BIGINT) AS a
    FROM (SELECT doc_id, t, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{rule}') AS ms, string_split_regex(t, '{rule}') AS gaps FROM t)))) WHERE {ok[kind]}""")
    told = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, {told} FILTER (k < {len(BASE)}) AS base, {told} AS spans, string_agg(score, ',' ORDER BY a, k) AS scores FROM found GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""
