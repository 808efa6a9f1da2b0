"""Secret scans with multipart credential linking; column functions and SQL operators only.

Base spans of three kinds come from patterns alone: assign (a named secret with its value), access (an
access identifier) and hex (a long hexadecimal run). Weak candidates are text that only matters beside
its complement: `secret` (a run of 40 or more base64 characters with both cases and a digit), `endpoint` (a URL
or an amazonaws host) and `shortid` (AKIA and 8 to 15 more characters). They are reported only if parts complete
each other within a scope of `scope` characters: a secret or endpoint beside an access identifier or
a short one; a short identifier beside a secret.

Linking is an interval join: identifiers and candidates of a document are one sequence in order of start,
and the last complement that began before and the first that begins after, running values of
a window, decide whether the scope holds one. Each part is looked at a constant number of times.

Positions are code points, end exclusive; matches of a kind are leftmost and don't overlap. Defined
results: null text counts as empty; rows with a null id are answered; rows that repeat an id and text
get the same spans; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.llm.common import staged, text_or_empty

# The patterns that define the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""(?s)^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds; the identifier that is too short for `access`, values, and places to use them. A value may follow '='.
SHORTID = r"(?<![A-Z0-9])AKIA[A-Z0-9]{8,15}(?![A-Z0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=_-])"
#: No repeated group: Java recurses once a repetition, and a text may hold a very long dotted name.
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9-][a-z0-9.-]*\.amazonaws\.com"""
KINDS = ("assign", "access", "hex", "shortid", "secret", "endpoint")
SCOPE = 400
#: Matches whose places are added up together.
CHUNK = 256


def spans(text: Column, pattern: str, kind: str, gate: str | None = None) -> Column:
    """Array of (start, kind number, end, match) of the matches of pattern, in order.

    The gaps that split() leaves and the matches alternate, so running lengths give the places. They run
    within chunks first and then over chunks, since an array that grows match by match is copied each time.
    gate, a cheaper pattern that any text with a match has, spares the rest the work.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    number = KINDS.index(kind)
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    seed = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.coalesce(F.length(p["h"]), F.lit(0))
        more = F.array(F.struct(start.alias("s"), F.lit(number).alias("k"), end.alias("e"), p["h"].alias("m")))
        return F.struct(end.alias("at"), F.when(p["h"].isNotNull(), F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    def chunks(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(pairs, i * CHUNK + 1, CHUNK), seed, step))

    def shift(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), x["k"].alias("k"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    # The one-element array binds the pairs to a variable, or every chunk would match the text again.
    bound = F.element_at(F.transform(F.array(F.arrays_zip(gaps.alias("g"), hits.alias("h"))), chunks), 1)
    found = F.flatten(F.aggregate(bound, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,k:int,e:int,m:string>>>").alias("out")), shift)["out"])
    return F.when(text.rlike(gate or pattern), found).otherwise(none)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_key, base, parts): base spans, and weak candidates before linking."""
    text = text_or_empty(F.col(text_col).cast("string"))
    assign = F.filter(spans(text, ASSIGN, "assign", r"(?i:pass|secret|token|api_?key)"), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 6)
    base = F.concat(assign, spans(text, ACCESS, "access"), spans(text, HEX, "hex"))
    weak = F.concat(spans(text, SHORTID, "shortid", "AKIA"), F.when(text.rlike("AKIA"), F.concat(spans(text, SECRET, "secret"), spans(text, ENDPOINT, "endpoint"))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return docs.select(F.col(id_col).cast("long").alias("id"), bare(base).alias("base"), bare(weak).alias("weak"), F.when(F.size(weak) > 0, F.sha2(text, 256)).alias("text_key"))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(l_id, l_key, more): of each distinct document the weak spans whose complement lies within scope."""
    some = rows.where(F.col("text_key").isNotNull()).dropDuplicates(["id", "text_key"])
    idents = F.filter("base", lambda x: x["k"] == KINDS.index("access"))
    parts = some.select("id", "text_key", F.inline(F.concat("weak", idents)))
    access, shortid, secret = (F.col("k") == KINDS.index(x) for x in ("access", "shortid", "secret"))
    order = Window.partitionBy("id", "text_key").orderBy("s", "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(kind: Column) -> Column:
        ended = F.max(F.when(kind, F.col("e"))).over(before)
        begins = F.min(F.when(kind, F.col("s"))).over(after)
        return F.coalesce(F.col("s") - ended <= scope, F.lit(False)) | F.coalesce(begins - F.col("e") <= scope, F.lit(False))

    kept = parts.select("id", "text_key", "s", "k", "e", F.when(shortid, near(secret)).when(access, False).otherwise(near(access | shortid)).alias("near")).where("near")
    return kept.groupBy(F.col("id").alias("l_id"), F.col("text_key").alias("l_key")).agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))


def _shown(spans_: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    at = lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans_), at), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a document: id, base and all spans as arrays of (s, k, e)."""
    rows = staged(scanned(docs, id_col, text_col))
    # Only documents with a candidate are linked; the others have a null key and join with nothing.
    out = rows.join(linked(rows, scope), F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return out.select("id", "base", F.concat("base", F.coalesce("more", none)).alias("spans"))


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of all documents."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan(docs).select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"),
    )


def _any_case(words: str) -> str:
    """words for an engine whose own case folding knows more than ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _runs(kind: str, pattern: str, where: str = "true", group: int = 0, gate: str = "true") -> str:
    """SQL for rows (r, k, s, e, m, g) of the matches of pattern; g is a group of theirs."""
    quoted = pattern.replace("'", "''")
    return f"""
SELECT r, k, s, s + length(m) AS e, m FROM (
  SELECT r, {KINDS.index(kind)} AS k, m, g, CAST(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i) - coalesce(length(m), 0) AS BIGINT) AS s
  FROM (SELECT r, unnest(regexp_split_to_array(t, '{quoted}')) AS gap, unnest(regexp_extract_all(t, '{quoted}')) AS m,
      unnest(regexp_extract_all(t, '{quoted}', {group})) AS g, generate_subscripts(regexp_split_to_array(t, '{quoted}'), 1) AS i FROM d WHERE {gate})
) WHERE m IS NOT NULL AND {where}"""


#: Plain matching and a comparison of all parts of a document; maximal runs stand for the patterns that look around.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_runs("assign", "(" + _any_case("password") + "|" + _any_case("passwd") + "|" + _any_case("secret") + "|" + _any_case("token") + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6", 2)}
UNION ALL {_runs("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
UNION ALL {_runs("hex", "[0-9a-f]+", "length(m) >= 24")}),
weak AS ({_runs("shortid", "[A-Z0-9]+", "regexp_full_match(m, 'AKIA[A-Z0-9]{8,15}')", gate="contains(t, 'AKIA')")}
UNION ALL {_runs("secret", "[A-Za-z0-9+/=_-]+", "regexp_full_match(m, '[A-Za-z0-9+/]{40,}={0,2}') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')", gate="contains(t, 'AKIA')")}
UNION ALL SELECT r, k, s + CAST(NOT regexp_matches(m, '^[a-z0-9-]') AS INT), e, m FROM ({_runs("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+|(?:^|[^A-Za-z0-9.-])[a-z0-9-][a-z0-9.-]*\.amazonaws\.com""", gate="contains(t, 'AKIA')")})),
parts AS (SELECT r, k, s, e FROM weak UNION ALL SELECT r, k, s, e FROM base WHERE k = 1),
linked AS (SELECT r, k, s, e FROM weak x WHERE EXISTS (SELECT 1 FROM parts y WHERE y.r = x.r AND x.s - y.e <= {SCOPE} AND y.s - x.e <= {SCOPE}
  AND CASE WHEN x.k = 3 THEN y.k = 4 ELSE y.k IN (1, 3) END)),
every AS (SELECT r, k, s, e, true AS own FROM base UNION ALL SELECT r, k, s, e, false FROM linked),
shown AS (SELECT *, list_extract({list(KINDS)}, k + 1) || ':' || s || ':' || e AS span FROM every),
told AS (SELECT r, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2,
  string_agg(span, ',' ORDER BY s, k, e) FILTER (WHERE own) AS base, string_agg(span, ',' ORDER BY s, k, e) AS spans FROM shown GROUP BY r)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
