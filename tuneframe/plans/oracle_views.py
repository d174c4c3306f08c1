"""The FIXTURES.md views in DuckDB SQL, for the independent oracle.

Each oracle query is ``WITH <views it needs> <query>``.
"""

from __future__ import annotations

VIEWS = {
    "records": """
SELECT conv_id * 100 + turn AS record_id, conv_id, turn,
       coalesce(sys, 'Answer the message.') AS instruction, text AS input, next_text AS output,
       'turn ' || cast(turn AS string) AS workflow, 'The reply follows the message.' AS success_condition
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
             max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys
      FROM conversations) t
WHERE role = 'user' AND next_role = 'assistant'""",
    "raw_lines": """
SELECT user_id AS file_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS line_no,
       CASE WHEN event_id % 97 = 5 THEN substr(props, 1, 4)
            WHEN event_id % 89 = 7 THEN '[' || props || ']'
            WHEN event_id % 83 = 9 THEN '  '
            WHEN event_id % 79 = 11 THEN replace(props, '"k"', '"q"')
            WHEN event_id % 73 = 3 THEN props || ' x'
            ELSE props END AS line
FROM events""",
    "job_events": """
SELECT user_id AS job_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, ts,
       CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'loading' WHEN 'click' THEN 'running'
                       WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
       cast(event_id % 50 AS int) AS step, 50 AS total_steps,
       CASE WHEN event_type = 'click' AND value < 30 THEN value END AS loss,
       event_type = 'click' AS loss_named,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'CUDA Out of Memory'
            WHEN event_type = 'error' THEN 'bad input' END AS error,
       user_id % 30 AS model_id
FROM events""",
    "models": """
SELECT n_nationkey AS model_id,
       CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'org/' || n_name END AS repo_id,
       CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS model_type
FROM nation""",
    "artifacts": """
SELECT source AS upload_id, doc_id AS pos,
       lang || '/' || cast(doc_id AS string) ||
       CASE doc_id % 3 WHEN 0 THEN '.safetensors' WHEN 1 THEN '.BIN' ELSE '.json' END AS path,
       n_chars AS size
FROM documents""",
    "shard_index": """
SELECT source AS index_dir, 'tensor.' || cast(doc_id AS string) AS tensor, cast(doc_id AS string) AS shard
FROM documents""",
    "shard_files": """
SELECT d.source AS dir, cast(l.doc_id AS string) AS name
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "upload_paths": """
SELECT page_id,
       CASE page_id % 6 WHEN 0 THEN '../' WHEN 1 THEN './' WHEN 2 THEN '/' WHEN 3 THEN 'a//' WHEN 4 THEN 'a' || chr(92) ELSE '' END
       || replace(replace(url, 'https://', ''), 'http://', '') AS path,
       md5(cast(page_id AS string)) || '_' || replace(url, '/', '_') AS stored_name
FROM pages""",
    "tensors": """
SELECT label AS file_id, vec_id, 'model.layers.' || cast(vec_id AS string) || '.self_attn.' ||
       CASE vec_id % 3 WHEN 0 THEN 'v_proj' WHEN 1 THEN 'q_proj' ELSE 'norm' END || '.weight' AS name,
       vec_id * 100 AS off_begin, vec_id * 100 + CASE WHEN vec_id % 41 = 0 THEN -1 ELSE 100 END AS off_end,
       cast(50000 AS BIGINT) AS data_size, cast(len(embedding) AS BIGINT) AS dims
FROM embeddings""",
    "requests": """
SELECT o_orderkey AS request_id, o_custkey AS dataset_id, o_orderkey % 30 AS model_id,
       CASE o_orderstatus WHEN 'F' THEN 'lora' WHEN 'O' THEN 'qlora' ELSE 'full' END AS method,
       cast(o_orderkey % 25 AS int) AS epochs, o_totalprice / 10000000.0 AS learning_rate,
       cast(o_orderkey % 70 AS int) AS adapter_rank, cast(o_orderkey % 3 AS int) AS batch_size
FROM orders""",
}


def with_views(sql: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``sql`` with the view CTEs it needs (in the order given), then
    any ``extra`` ``(name, query)`` CTEs built on them."""
    ctes = [f"{n} AS ({VIEWS[n]}\n)" for n in names] + [f"{n} AS ({q})" for n, q in extra]
    return f"WITH {',\n'.join(ctes)}\n{sql}" if ctes else sql
