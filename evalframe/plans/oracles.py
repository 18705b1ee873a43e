"""DuckDB SQL twins of the fixtures and queries (the correctness oracle).

Each oracle reads only the driver's pre-registered views and re-derives its
fixture inside a CTE, so Spark and DuckDB see the same rows.  Doubles are
rounded to 9 digits on both sides.
"""

from __future__ import annotations

from evalframe.constants import PY_WHITESPACE, PY_WHITESPACE_CLASS_RE2

WS_CHARS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
CHOICE_RX_SQL = "'^" + PY_WHITESPACE_CLASS_RE2 + r"*\(?(-1|[0-5]|[A-B]|yes|no)[.,:;)]?'"


def lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10) so templates stay readable."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def extract_sql(text: str) -> str:
    return f"coalesce(nullif(regexp_extract({text}, {CHOICE_RX_SQL}, 1), ''), '-100')"


def code_int_sql(parsed: str) -> str:
    return f"coalesce(TRY_CAST({parsed} AS INTEGER), -100)"


def pdf_sql(x: str, mu: str, sd: str) -> str:
    z = f"((CAST({x} AS DOUBLE) - {mu}) / ({sd}))"
    return f"(exp(-0.5 * {z} * {z}) / (({sd}) * sqrt(2 * pi())))"


def distance_sql(gold: str, pred: str, mu: str, sd: str, unanimous: str) -> str:
    return (
        f"CASE WHEN NOT ({pred} BETWEEN 1 AND 5) THEN CAST(NULL AS DOUBLE) "
        f"WHEN {unanimous} AND {gold} = {pred} THEN 0e0 "
        f"WHEN {unanimous} THEN abs(1e0 - {pdf_sql(pred, mu, sd + ' + 0.001')}) "
        f"ELSE abs({pdf_sql(gold, mu, sd)} - {pdf_sql(pred, mu, sd)}) END"
    )


# ---------------------------------------------------------------------------
# fixture CTE bodies (name -> SELECT)
# ---------------------------------------------------------------------------

RAW_TEXT = """
raw_text AS (
  SELECT 'conv' AS src, conv_id AS k1, turn AS k2, text FROM conversations
  UNION ALL
  SELECT 'doc' AS src, doc_id AS k1, CAST(0 AS BIGINT) AS k2, text FROM documents)"""

CHOICE_ITEMS = """
choice_base AS (
  SELECT p_partkey AS id, p_name AS object, CAST(p_partkey % 5 AS INTEGER) AS m,
         string_split(concat_ws(' ', lower(p_type), p_name, lower(p_brand)), ' ') AS _words
  FROM part),
choice_k AS (
  SELECT id, object, m, _words,
         CASE WHEN m = 4 THEN 'random' ELSE 'choice' || CAST(m + 2 AS VARCHAR) || '_ans1' END AS sub_subtask,
         CAST(CASE WHEN m = 4 THEN 3 ELSE m + 2 END AS INTEGER) AS k
  FROM choice_base),
choice_items AS (
  SELECT id, object, sub_subtask, k,
         CASE WHEN m = 4 AND id % 3 = 0 THEN CAST([] AS INTEGER[])
              ELSE [CAST((id % 7) % k AS INTEGER)] END AS correct_ids,
         list_transform(range(0, k), lambda i: CAST(i AS VARCHAR) || ':' || coalesce(_words[i + 1], 'none')) AS all_ids_with_term,
         CAST(CASE WHEN id % 4 = 0 THEN (id % 3) % k ELSE (id % 7) % k END AS VARCHAR) AS _c
  FROM choice_k),
choice_responses AS (
  SELECT id, object, sub_subtask, k, correct_ids, all_ids_with_term,
         CASE id % 12 WHEN 0 THEN '(' || _c || ') because'
                      WHEN 1 THEN _c || '.'
                      WHEN 2 THEN chr(10) || ' ' || _c
                      WHEN 3 THEN chr(12288) || _c
                      WHEN 4 THEN 'Answer: ' || _c
                      WHEN 5 THEN 'yes'
                      WHEN 6 THEN 'I think ' || _c
                      WHEN 7 THEN '-1'
                      ELSE _c END AS recorded_response
  FROM choice_items)"""

VOTES = """
votes_long AS (
  SELECT l_orderkey AS item, CAST((CAST(floor(l_quantity) AS BIGINT) % 5) + 1 AS INTEGER) AS vote FROM lineitem),
vote_stats AS (
  SELECT item, avg(CAST(vote AS DOUBLE)) AS vote_mean, stddev_samp(CAST(vote AS DOUBLE)) AS vote_sd,
         min(vote) = max(vote) AS unanimous, count(*) AS n_votes, max(vote) AS vote_max
  FROM votes_long GROUP BY item)"""

PAIR_ITEMS = """
pair_items AS (
  SELECT o_orderkey AS id, o_orderpriority AS object, lower(o_orderstatus) AS term,
         CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 7 AS VARCHAR) || '. natural'
                             WHEN 1 THEN '(' || CAST(o_orderkey % 7 AS VARCHAR) || ')'
                             ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS recorded_response
  FROM orders)"""

VOTE_ARRAYS = """
vote_arrays AS (
  SELECT vec_id AS item,
         list_transform(embedding, lambda x: CAST((CAST(floor(abs(CAST(x AS DOUBLE)) * 5) AS BIGINT) % 5) + 1 AS INTEGER)) AS votes,
         CAST((CAST(label AS BIGINT) % 5) + 1 AS INTEGER) AS gold,
         CAST(vec_id % 7 AS INTEGER) AS pred
  FROM embeddings)"""

YES_NO = """
yes_no_items AS (
  SELECT doc_id AS id, CAST(quality AS INTEGER) AS label,
         CASE WHEN doc_id % 9 = 0 THEN '1' WHEN doc_id % 4 = 0 THEN 'no' ELSE 'yes' END AS recorded_response
  FROM labels)"""

A_B = """
a_b_items AS (
  SELECT doc_id AS id, [CAST(toxic AS INTEGER)] AS correct_ids,
         CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B.' WHEN 2 THEN '(A)'
                         WHEN 3 THEN 'B: because' WHEN 4 THEN 'yes' ELSE ' 1' END AS recorded_response
  FROM labels)"""

MESSAGES_ORDERED = """
msgs AS (SELECT conv_id, turn, role, text FROM conversations),
firsts AS (SELECT conv_id, arg_min(role, turn) AS first_role, count(*) AS n_msgs FROM msgs GROUP BY conv_id)"""

FEW_SHOT_PAIRS = """
conv_lead AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations),
few_shot_pairs AS (
  SELECT conv_id AS fs_id, turn AS ord, text AS "user", next_text AS assistant
  FROM conv_lead WHERE role = 'user' AND next_role = 'assistant')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


def render_sql(template: str, **slots: str) -> str:
    """SQL twin of ``functions.prompts.render``."""
    from evalframe.functions.prompts import template_parts

    parts = []
    for kind, val in template_parts(template):
        parts.append(lit(val) if kind == "lit" else f"CAST({slots[val]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


MSG_RANKED = f"""
msg_first AS (
  SELECT conv_id, arg_min(role, turn) AS first_role, arg_min(text, turn) AS first_text, count(*) AS n_msgs
  FROM conversations GROUP BY conv_id),
msg_ranked AS (
  SELECT c.conv_id, c.turn, c.role, c.text, f.first_role, f.first_text, f.n_msgs,
         CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS BIGINT) AS rn,
         (f.first_role = 'system') AS has_sys
  FROM conversations c JOIN msg_first f ON c.conv_id = f.conv_id),
msg_rest AS (
  SELECT *, rn - CASE WHEN has_sys THEN 1 ELSE 0 END AS idx, (has_sys AND rn = 0) AS is_sys_head,
         CASE WHEN has_sys AND rn = 1 AND coalesce(first_text, '') <> ''
              THEN first_text || chr(10) || chr(10) || text ELSE text END AS folded
  FROM msg_ranked)"""
