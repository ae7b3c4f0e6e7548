"""Secret scans in SQL functions alone: three fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a run of 20 or more base64 or hex characters. A window of ``WINDOW`` characters slides
over it with the count of each character in it: one count falls and one rises a step, and the sum of
``c log2 c`` over the counts changes by those two terms alone; Shannon entropy follows from it. Windows
at or above the threshold of the candidate's class (hex or base64) merge into spans. Candidates that as
a whole look like words or identifiers are suppressed (``allowed``), and so are windows that hold a
placeholder or a sequence (``LOCAL``), but not the rest of their candidate. Spans that overlap a fixed
pattern's span stand beside it, since a merged span may reach far beyond.

Positions come from the lengths of matches and of the text between them, summed in blocks; candidates
are walked in parts of ``PART`` characters, and spans merge by one pass over them in order. So neither
a very long candidate nor a text with very many matches takes quadratic time, and no pattern repeats a
group, which Java would match by recursion. Nothing is shuffled.

Defined results: null text counts as empty (no spans, the digest of the empty string); positions are
code points, end exclusive, of the whole match; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
#: Pattern, the group whose length counts, and its least length. A run of 16 or more hex characters, or
#: 14 or more after AKIA, is what a shorter pattern with a length test finds, since its runs are greedy.
PATTERNS = (
    (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    (r"AKIA[A-Z0-9]{14,}", 0, 18),
    (r"[0-9a-f]{16,}", 0, 16),
)
CANDIDATE, WINDOW = r"[A-Za-z0-9+/=_-]{20,}", 20
HEX, HEX_BITS, BASE64_BITS = r"^[0-9A-Fa-f]+$", 3.0, 3.7
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: What a candidate of words joined by - _ / = + doesn't hold: a joint at an end, a letter beside a digit.
UNJOINED = r"^[-_/=+]|[-_/=+]$|[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Of one window: placeholder words; one character four times over; sequences.
LOCAL = r"(?i:example|sample|placeholder|changeme|dummy|xxxx)|(.)\1{3}|(?i:0123456789|abcdefgh)"
BLOCK, PART, MARK = 128, 236, "[SECRET]"
#: ``s``, ``e`` in code points; ``b`` the end in bytes. Matches are ASCII, so their bytes are as many as their characters.
SPAN = "array<struct<s:bigint,k:int,e:bigint,b:bigint>>"
#: Characters of candidates lie between the one after this and z; a count is kept as the character so far above zero's.
FIRST, ZERO, SYMBOLS = 42, 48, 80


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def allowed(candidate: Column) -> Column:
    """Whether a whole candidate is none: no digit or no letter, a UUID, or words joined by - _ / = +."""
    return ~candidate.rlike("[0-9]") | ~candidate.rlike("[A-Za-z]") | ~candidate.rlike(UNJOINED) | candidate.rlike(UUID)


def _running(values: Column, join) -> Column:
    """``join`` of each element of an array of longs with all before it, starting from 0; in blocks."""

    def upto(x: Column, of) -> Column:
        return F.slice(F.aggregate(x, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(join(F.element_at(a, -1), of(v))))), 2, 1 << 30)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: upto(F.slice(values, b * BLOCK + 1, BLOCK), lambda v: v))
    return _let(
        blocks,
        lambda parts: _let(
            F.concat(F.array(F.lit(0).cast("long")), upto(parts, lambda p: F.element_at(p, -1))),
            lambda before: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda v: join(v, F.element_at(before, i + 1))))),
        ),
    )


def _merged(spans: Column, kind: str) -> Column:
    """Ranges ``s, e`` (of ``kind``), sorted by ``s``, as maximal ones: those that touch or overlap become one."""

    def ends(x: Column, top: Column) -> Column:
        last = F.size(x)
        begin = F.filter(x, lambda v, i: (i == 0) | (v["s"] > F.element_at(top, F.greatest(i, F.lit(1)))))
        end = F.filter(top, lambda v, i: (i + 1 == last) | (F.element_at(x, F.least(i + 2, last))["s"] > v))
        return F.zip_with(begin, end, lambda v, e: F.struct(v["s"].alias("s"), e.alias("e")))

    some = _let(spans, lambda x: _let(_running(F.transform(x, lambda v: v["e"]), F.greatest), lambda top: ends(x, top)))
    return F.when(F.size(spans) > 1, some).otherwise(F.transform(spans, lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e")))).cast(kind)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """``s, e`` (code points), the end in bytes ``b``, the match ``m`` and its group ``g`` of each match; null where there is none."""
    plus = lambda a, v: a + v
    ends = lambda x, size: _running(F.zip_with(x["m"], F.slice(x["gap"], 1, F.size(x["m"])), lambda m, gap: (F.length(m) + size(gap)).cast("long")), plus)
    made = _let(
        F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)).alias("g"), F.split(text, pattern, -1).alias("gap")),
        lambda x: _let(
            F.struct(x["m"].alias("m"), x["g"].alias("g"), ends(x, F.length).alias("e"), ends(x, F.octet_length).alias("b")),
            lambda y: F.transform(
                y["m"],
                lambda m, i: F.struct((F.element_at(y["e"], i + 1) - F.length(m)).alias("s"), F.element_at(y["e"], i + 1).alias("e"), F.element_at(y["b"], i + 1).alias("b"), m.alias("m"), F.element_at(y["g"], i + 1).alias("g")),
            ),
        ),
    )
    return F.when(text.rlike(pattern), made)


def _windows(chars: Column, least: Column, some: Column) -> Column:
    """Merged windows of a few hundred characters whose entropy is ``least`` or more; without ``LOCAL``, where ``some`` says there is any."""

    def f(c: Column) -> Column:  # c log2 c
        return F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def moved(z: Column, char: Column, by: int) -> Column:
        """The counts and their sum, one character more or fewer in the window."""
        return _let(
            F.ascii(char) - FIRST,
            lambda at: _let(
                F.ascii(F.substring(z["n"], at, F.lit(1))) - ZERO,
                lambda c: F.struct(F.overlay(z["n"], F.char(c + ZERO + by), at, F.lit(1)).alias("n"), (z["t"] - f(c) + f(c + by)).alias("t")),
            ),
        )

    def step(z: Column, i: Column) -> Column:
        # the window ends at character i, from 1; what falls out of it is WINDOW before
        counts = F.struct(z["n"].alias("n"), z["t"].alias("t"))
        left = F.when(i > WINDOW, moved(counts, F.element_at(chars, F.greatest(i - WINDOW, F.lit(1))), -1)).otherwise(counts)
        held = lambda: F.array_join(F.slice(chars, F.greatest(i - WINDOW + 1, F.lit(1)), WINDOW), "").rlike(LOCAL)
        return _let(
            _let(left, lambda x: moved(x, F.element_at(chars, i), 1)),
            lambda x: F.struct(
                x["n"].alias("n"),
                x["t"].alias("t"),
                F.when((i < WINDOW) | (F.log2(F.lit(float(WINDOW))) - x["t"] / WINDOW < least - 1e-9), z["o"])
                .when(some & held(), z["o"])
                .when((F.size(z["o"]) > 0) & (F.element_at(z["o"], -1)["e"] >= i - WINDOW), F.concat(F.slice(z["o"], 1, F.size(z["o"]) - 1), F.array(F.struct(F.element_at(z["o"], -1)["s"].alias("s"), i.alias("e")))))
                .otherwise(F.concat(z["o"], F.array(F.struct((i - WINDOW).alias("s"), i.alias("e")))))
                .alias("o"),
            ),
        )

    start = F.struct(F.lit(chr(ZERO) * SYMBOLS).alias("n"), F.lit(0.0).alias("t"), F.array().cast("array<struct<s:int,e:int>>").alias("o"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda z: z["o"])


def _entropy_spans(candidate: Column) -> Column:
    """Spans of one candidate string, relative to its start: windows at or above its class's threshold and without ``LOCAL``, merged."""
    least = F.when(candidate.rlike(HEX), HEX_BITS).otherwise(BASE64_BITS)

    def part(parts: Column, p: Column, i: Column, x: Column) -> Column:
        """Windows that end in part ``i``: those of the part behind the last characters of the one before."""
        lead = F.when(i > 0, F.right(F.element_at(parts, F.greatest(i, F.lit(1))), F.lit(WINDOW - 1))).otherwise("")
        found = _let(F.split(F.concat(lead, p), ""), lambda chars: _windows(chars, x["b"], x["l"]))
        before = i.cast("long") * PART - F.length(lead)
        return F.transform(found, lambda v: F.struct((before + v["s"]).alias("s"), (before + v["e"]).alias("e")))

    return _let(
        F.struct(F.regexp_extract_all(candidate, F.lit(f".{{1,{PART}}}"), F.lit(0)).alias("p"), least.alias("b"), candidate.rlike(LOCAL).alias("l")),
        lambda x: _let(F.flatten(F.transform(x["p"], lambda p, i: part(x["p"], p, i, x))), lambda found: _merged(found, "array<struct<s:bigint,e:bigint>>")),
    )


def spans(text: Column) -> Column:
    """All spans of a text: ``s`` and ``e`` in code points, ``k`` the kind's place in ``KINDS``, ``b`` the end in bytes; by start, then kind."""
    none = F.array().cast(SPAN)

    def fixed(kind: int, pattern: str, group: int, least: int) -> Column:
        held = F.filter(_matches(text, pattern, group), lambda m: F.length(m["g"]) >= least)
        return F.coalesce(F.transform(held, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e"), m["b"].alias("b"))), none)

    kept = F.filter(_matches(text, CANDIDATE, 0), lambda m: ~allowed(m["m"]))
    more = F.flatten(
        F.transform(kept, lambda m: F.transform(_entropy_spans(m["m"]), lambda x: F.struct((m["s"] + x["s"]).alias("s"), F.lit(3).alias("k"), (m["s"] + x["e"]).alias("e"), (m["b"] - m["e"] + m["s"] + x["e"]).alias("b"))))
    )
    return F.array_sort(F.concat(*[fixed(k, *p) for k, p in enumerate(PATTERNS)], F.coalesce(more, none)))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` of every whole text of ``docs(doc_id, text)``: ``s``, ``k``, ``e`` of each span."""
    bare = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    return docs.select(F.col("doc_id").cast("long"), F.transform(spans(F.coalesce("text", F.lit(""))), bare).alias("found"))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The rows of ``docs`` with each span of ``text``, or each of spans that touch or overlap, replaced by ``mark``; a text without spans stays as it is."""
    columns = docs.columns

    def joined(text: Column, cuts: Column) -> Column:
        raw, n = text.cast("binary"), F.size(cuts)
        end = lambda i: F.when(i > 0, F.element_at(cuts, F.greatest(i, F.lit(1)))["e"]).otherwise(0)
        gap = lambda i: F.substring(raw, (end(i) + 1).cast("int"), (F.when(i < n, F.element_at(cuts, F.least(i + 1, n))["s"]).otherwise(F.octet_length(text)) - end(i)).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: gap(i).cast("string")), mark)

    def bytes_of(found: Column) -> Column:
        return _merged(F.transform(found, lambda x: F.struct((x["b"] - x["e"] + x["s"]).alias("s"), x["b"].alias("e"))), "array<struct<s:bigint,e:bigint>>")

    text = _let(F.coalesce(F.col("text"), F.lit("")), lambda t: _let(spans(t), lambda found: F.when(F.size(found) == 0, t).otherwise(_let(bytes_of(found), lambda cuts: joined(t, cuts)))))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    written = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    number = lambda a, k: F.size(F.filter(a, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    made = lambda a: F.struct(
        *[number(a, k) for k in range(3)],
        F.sha2(F.array_join(F.transform(F.filter(a, lambda x: x["k"] < 3), written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(a, written), ",").alias("spans"),
    )
    found = scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", _let(F.col("found"), made).alias("r")).select("doc_id", "r.*")


def _sql_matches(name: str, pattern: str, group: int, least: int) -> str:
    """A view of the matches of one pattern, placed by the lengths of what lies between them."""
    quoted, whole = "'" + pattern.replace("'", "''") + "'", "'(" + pattern.replace("'", "''") + ")'"
    return f"""
{name}_m AS (
  SELECT n, unnest(regexp_extract_all(t, {whole}, 1)) AS m, unnest(regexp_extract_all(t, {whole}, {group + 1})) AS g,
         unnest(string_split_regex(t, {quoted})[:len(regexp_extract_all(t, {whole}, 1))]) AS gap, unnest(range(len(regexp_extract_all(t, {whole}, 1)))) AS i
  FROM d WHERE regexp_matches(t, {quoted})),
{name} AS (
  SELECT * FROM (
    SELECT n, m, g, sum(len(gap) + len(m)) OVER (PARTITION BY n ORDER BY i) - len(m) AS s, sum(len(gap) + len(m)) OVER (PARTITION BY n ORDER BY i) AS e FROM {name}_m)
  WHERE len(g) >= {least}),"""


#: The class of a candidate, the suppressions and each window's entropy written out anew; windows merge by islands.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
{"".join(_sql_matches(k, *p) for k, p in zip(KINDS, PATTERNS, strict=False))}
{_sql_matches("candidate", CANDIDATE, 0, WINDOW)}
kept AS (
  SELECT n, s, m, CASE WHEN regexp_matches(m, '{HEX}') THEN {HEX_BITS} ELSE {BASE64_BITS} END AS bits
  FROM candidate
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{UUID}')
    AND NOT regexp_full_match(m, '([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*')),
w AS (SELECT n, s + a AS a, m[a + 1:a + {WINDOW}] AS x, bits FROM kept, unnest(range(len(m) - {WINDOW - 1})) AS r(a)),
hot AS (
  SELECT n, a FROM w
  WHERE list_aggregate(string_split(x, ''), 'entropy') >= bits - 1e-9
    AND NOT regexp_matches(x, '(?i:example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh)')
    AND len(list_filter(range(1, {WINDOW - 2}), lambda i: x[i] = x[i + 1] AND x[i] = x[i + 2] AND x[i] = x[i + 3])) = 0),
step AS (SELECT n, a, CASE WHEN a <= lag(a) OVER (PARTITION BY n ORDER BY a) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot),
island AS (SELECT n, a, sum(fresh) OVER (PARTITION BY n ORDER BY a) AS k FROM step),
every AS (
  {" UNION ALL ".join(f"SELECT n, {i} AS kind, '{k}' AS name, s, e FROM {k}" for i, k in enumerate(KINDS[:3]))}
  UNION ALL SELECT n, 3, 'entropy', min(a), max(a) + {WINDOW} FROM island GROUP BY n, k),
found AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans
  FROM every GROUP BY n)
SELECT doc_id::BIGINT AS doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (n)
"""
