"""Pieces of ANSI SQL for checking queries with another engine: generator draws, spans, plans, mock verdicts."""

from __future__ import annotations

from larkspan.operators.dimensions import GLBA_WEIGHTS, HIPAA_TO_PLACEHOLDER, HIPAA_WEIGHTS, PLACEHOLDER_TO_GLBA, PLACEHOLDER_TO_HIPAA, SPURIOUS_TYPES


def draws(source: str, seed: str, k: str, keep: str, name: str = "drawn") -> str:
    """CTEs that end in `name`: columns keep and r, draw k of seed for each row of source."""
    a = f"(({seed})::BIGINT + ({k})::BIGINT * 1831565813) & 4294967295"
    return f"""{name}_a AS (SELECT {keep}, {a} AS a FROM {source}),
{name}_t AS (SELECT *, ((xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT) & 4294967295)::BIGINT AS t FROM {name}_a),
{name}_u AS (SELECT *, xor(t, (t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) & 4294967295)::BIGINT) & 4294967295) AS u FROM {name}_t),
{name} AS MATERIALIZED (SELECT {keep}, xor(u, u >> 14) / 4294967296.0::DOUBLE AS r FROM {name}_u)"""


def weighted(r: str, weights: list[tuple[str, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {r} < {w}::DOUBLE THEN '{n}'" for n, w in weights[:-1]) + f" ELSE '{weights[-1][0]}' END"


def mapped(key: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {default} END"


def spans(table: str, key: str, pattern: str, name: str = "s", text: str = "text", keep: str = "") -> str:
    """A CTE `name`: key, keep, ordinal (from 0), start, end, value of each match."""
    p = pattern.replace("'", "''")
    more = f", {keep}" if keep else ""
    order = f"OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_m AS (SELECT {key}{more}, regexp_extract_all({text}, '{p}') AS f, string_split_regex({text}, '{p}') AS g FROM {table}),
{name}_e AS (SELECT {key}{more}, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS value, unnest(g[1:len(f)]) AS gap FROM {name}_m WHERE len(f) > 0),
{name} AS MATERIALIZED (SELECT {key}{more}, (i - 1)::BIGINT AS ordinal, (sum(length(gap) + length(value)) {order} - length(value))::BIGINT AS start, (sum(length(gap) + length(value)) {order})::BIGINT AS "end", value FROM {name}_e)"""


def plan(weights: list[tuple[str, float]] = HIPAA_WEIGHTS) -> str:
    """CTEs that end in `planned`: doc_id, ordinal (from 1), position, category, value of nine digits."""
    return f"""base AS (SELECT doc_id, coalesce(text, '') AS text, greatest(length(coalesce(text, '')), 1) AS len, (42 * 1000003 + doc_id) & 4294967295 AS seed FROM documents),
numbers AS (SELECT doc_id, len, seed, unnest(range(1, 277)) AS k FROM base),
{draws("numbers", "seed", "k", "doc_id, len, k", "dr")},
target AS (SELECT doc_id, 20 + floor(r * 6)::INT AS target FROM dr WHERE k = 1),
tries AS (SELECT doc_id, k - 1 AS j, floor(r * (len + 1))::BIGINT AS pos, target FROM dr JOIN target USING (doc_id) WHERE k BETWEEN 2 AND 10 * target + 1),
firsts AS (SELECT doc_id, pos, min(j) AS j, any_value(target) AS target FROM tries GROUP BY doc_id, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS rk FROM firsts),
kept AS MATERIALIZED (SELECT * FROM ranked WHERE rk <= target),
used AS (SELECT doc_id, CASE WHEN count(*) = any_value(target) THEN max(j) ELSE 10 * any_value(target) END AS used FROM kept GROUP BY doc_id),
placed AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM kept),
planned AS MATERIALIZED (SELECT p.doc_id, p.ordinal, p.pos AS position, {weighted("d.r", weights)} AS category,
  lpad((('0x' || substr(md5(p.doc_id || ':' || p.ordinal), 1, 15))::BIGINT % 1000000000)::VARCHAR, 9, '0') AS value
  FROM placed p JOIN used u USING (doc_id) JOIN dr d ON d.doc_id = p.doc_id AND d.k = 1 + u.used + p.ordinal)"""


def injected() -> str:
    """plan() and a CTE `injected`: doc_id, text with the values, n, start_sum."""
    return f"""{plan()},
gap AS (SELECT doc_id, position, value, ordinal, coalesce(lag(position) OVER (PARTITION BY doc_id ORDER BY ordinal), 0) AS prev FROM planned),
body AS (SELECT gap.doc_id, string_agg(substr(b.text, prev + 1, position - prev) || ' ' || value || ' ', '' ORDER BY ordinal) AS body, max(position) AS last, count(*) AS n, sum(position + 1 + (ordinal - 1) * 11)::BIGINT AS start_sum FROM gap JOIN base b USING (doc_id) GROUP BY gap.doc_id),
injected AS MATERIALIZED (SELECT doc_id, body || substr(b.text, last + 1) AS text, n, start_sum FROM body JOIN base b USING (doc_id))"""


def mock_facts(weights: list[tuple[str, float]] = HIPAA_WEIGHTS, mapping: dict[str, str] = PLACEHOLDER_TO_HIPAA, miss: float = 0.2, spurious: int = 2) -> str:
    """CTEs that end in `facts`: row_index, category, verdict, value, placeholder, with up to four spurious detections a row."""
    wrong = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SPURIOUS_TYPES[:spurious]))
    kind = mapped("category", HIPAA_TO_PLACEHOLDER, "'ID'")
    return f"""{plan(weights)},
{draws("planned", "doc_id", "ordinal", "doc_id, ordinal, category, value", "mk")},
hits AS MATERIALIZED (SELECT *, r < {miss}::DOUBLE AS miss, {kind} AS type FROM mk),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY ordinal) AS n FROM hits WHERE NOT miss),
counts AS (SELECT doc_id, type, count(*) AS n FROM numbered GROUP BY doc_id, type),
extra AS (SELECT b.doc_id, t.i, t.type, 1 + coalesce(c.n, 0) AS n FROM base b CROSS JOIN (VALUES {wrong}) t(i, type) LEFT JOIN counts c ON c.doc_id = b.doc_id AND c.type = t.type),
facts AS (
  SELECT doc_id AS row_index, category, 'tp' AS verdict, value, '[' || type || '_' || n || ']' AS placeholder FROM numbered
  UNION ALL SELECT doc_id, category, 'fn', value, NULL FROM hits WHERE miss
  UNION ALL SELECT doc_id, {mapped("type", mapping)}, 'fp', 'spurious_' || doc_id || '_' || i, '[' || type || '_' || n || ']' FROM extra)"""


FINANCE_FACTS = (GLBA_WEIGHTS, PLACEHOLDER_TO_GLBA)

COUNTS = "count(*) FILTER (WHERE verdict = 'tp') AS tp, count(*) FILTER (WHERE verdict = 'fp') AS fp, count(*) FILTER (WHERE verdict = 'fn') AS fn"


def rated(source: str, keep: str) -> str:
    z = lambda a, b: f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)"
    return f"SELECT {keep} tp, fp, fn, {z('tp', 'tp + fn')} AS recall, {z('tp', 'tp + fp')} AS \"precision\", {z('2 * tp', '2 * tp + fp + fn')} AS f1 FROM {source}"


def dimension(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(names)) + ") AS dim(category, ordinal)"


#: Spark's canonical() in SQL, for texts without unusual white space.
CANONICAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
#: The NFKC, case-folded form in SQL, for texts whose one sign that folding or NFKC changes is the sharp s.
NFKC = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\s+', ' ', 'g'))"
