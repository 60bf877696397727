"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

HARD_NEGATIVES = """
WITH quantised AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM quantised a JOIN quantised b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def _row(source: str, cost: str, letter: str, line: str = "") -> str:
    text = f"{source}.t || {line}" if line else f"{source}.t"
    return f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 't': {text}}}"


def _inserted(s: str) -> str:
    """Costs of the four states when one more row may be inserted."""
    user = ", ".join(_row(f"{s}[{k}]", "5", "I", "chr(10) || 'user:'") for k in (1, 2, 4))
    assistant = _row(f"{s}[3]", "5", "I", "chr(10) || 'assistant:'")
    return f"[{s}[1], {s}[2], list_min([{s}[3], {user}]), list_min([{s}[4], {assistant}])]"


def _stepped(s: str) -> str:
    """Costs of the four states after a row: deleted, kept where its initial may follow, or with a new role."""
    delete = [_row(f"{s}[{k}]", "2", "D") for k in (1, 2, 3, 4)]

    def keep(k: int, initial: str) -> str:
        return _row(f"{s}[{k}]", f"extra + CASE WHEN must OR initial <> '{initial}' THEN 1000000 ELSE 0 END", "K", "chr(10) || role || ':' || text")

    def turn(k: int, role: str) -> str:
        return _row(f"{s}[{k}]", "1 + extra + CASE WHEN must THEN 1000000 ELSE 0 END", "R", f"chr(10) || '{role}:' || text")

    user = ", ".join([delete[2], *(keep(k, "u") for k in (1, 2, 4)), *(turn(k, "user") for k in (1, 2, 4))])
    return f"[{delete[0]}, list_min([{delete[1]}, {keep(1, 's')}]), list_min([{user}]), list_min([{delete[3]}, {keep(3, 'a')}, {turn(3, 'assistant')}])]"


# CRC-32 by its definition: a byte is added, then eight bits are shifted out
CONVERSATIONS = f"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(range(1, length(place) + 1), lambda k: list_concat([CAST(ascii(place[k]) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS kind
  FROM placed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0
), ordered AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i
  FROM damaged
), faults AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM ordered
), marked AS (
  SELECT *, blank OR duplicate AS must, CASE WHEN NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra
  FROM faults
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (extra > 0) AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), convs AS (
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
         coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
), walk AS (
  SELECT conv_id, n, 0 AS i, [{{'c': 0, 'a': '', 't': ''}}, {{'c': 1000000, 'a': '', 't': ''}}, {{'c': 1000000, 'a': '', 't': ''}},
         {{'c': 1000000, 'a': '', 't': ''}}] AS s
  FROM convs
  UNION ALL
  SELECT conv_id, n, i + 1, {_stepped("s")}
  FROM (SELECT conv_id, n, i, must, extra, initial, role, text, {_inserted("s")} AS s
        FROM (SELECT w.conv_id, w.n, w.i, must, extra, initial, role, text, {_inserted("w.s")} AS s
              FROM walk w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1))
), ended AS (
  SELECT conv_id, list_min([s[1], s[4]]) AS best
  FROM (SELECT conv_id, {_inserted("s")} AS s FROM (SELECT conv_id, {_inserted("s")} AS s FROM walk WHERE i = n))
)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM convs c JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
