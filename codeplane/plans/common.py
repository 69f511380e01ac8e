"""SQL pieces that several oracles share."""

FP = r"regexp_replace(replace(file_path, '\', '/'), '^(?:\./+)+', '')"
#: Clean chunks, one row per key.
CC = f"""cc AS (SELECT * REPLACE (fp AS file_path) FROM (SELECT *, {FP} AS fp, row_number() OVER (PARTITION BY repo_id, {FP}, ord
 ORDER BY indexed_at DESC, chunk_id DESC, content DESC) AS rn FROM chunks WHERE file_path IS NOT NULL) WHERE rn = 1)"""
#: One row per call, the latest arrival.
TU = "tu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY arrived_at DESC) AS rn FROM token_usage) WHERE rn = 1)"
#: A file's kind by its path's ending.
EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"
