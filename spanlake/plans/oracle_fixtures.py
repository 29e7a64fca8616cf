"""The fixture views of ``fixtures.py`` written as portable SQL (DuckDB dialect), used by
the independent oracle queries.  ``with_fx(names, body)`` prefixes a query with the CTEs
it needs (dependencies included)."""

from __future__ import annotations

TOKEN_RE = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"

_FX = {
    "fx_files": ([], f"""fx_files AS (
  SELECT d.doc_id AS row_id, 'test' AS split, d.source AS query_name,
         'src/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS code_file_path,
         d.text AS content, CAST(coalesce(l.quality, CASE WHEN length(d.text) % 3 > 0 THEN 1 ELSE 0 END) AS INTEGER) AS em,
         CAST(d.doc_id % 2 AS INTEGER) AS example_type,
         CAST(len(regexp_extract_all(d.text, '{TOKEN_RE}')) AS INTEGER) AS file_tokens
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""),
    "fx_rows": ([], f"""fx_rows AS (
  SELECT conv_id * 4294967296 + turn AS row_id,
         CASE WHEN conv_id % 5 = 0 THEN 'train' ELSE 'test' END AS split,
         'q' || CAST((conv_id // 10) % 10 AS VARCHAR) AS query_name,
         'src/c' || CAST(conv_id AS VARCHAR) || '.py' AS code_file_path,
         conv_id, turn, role, text,
         CASE WHEN conv_id % 2 = 1
              THEN list_filter(string_split(text, chr(10)), lambda l: length(l) % 2 = 1)
              ELSE CAST([] AS VARCHAR[]) END AS answer_texts,
         CASE WHEN conv_id % 2 = 1
              THEN list_filter(string_split(text, chr(10)), lambda l: length(l) % 2 = 0)
              ELSE CAST([] AS VARCHAR[]) END AS fact_texts,
         CAST(conv_id % 2 AS INTEGER) AS example_type,
         CASE WHEN length(text) % 3 > 0 THEN 1 ELSE 0 END AS em,
         CAST(len(regexp_extract_all(text, '{TOKEN_RE}')) AS INTEGER) AS file_tokens
  FROM conversations)"""),
    "fx_blocks": (["fx_rows"], """fx_blocks AS (
  SELECT row_id, split, query_name, example_type, conv_id, turn, role, text, answer_texts,
         'src/c' || CAST(conv_id AS VARCHAR) || '_' || role || '.py' AS code_file_path,
         CAST(turn AS INTEGER) AS block_index, CAST(turn AS INTEGER) AS block_ordinal,
         CAST(length(text) % 2 = 0 AS INTEGER) AS relevance_label,
         CASE WHEN length(text) % 3 > 0 THEN 1 ELSE 0 END AS predicted,
         list_concat([query_name, '[SEP]_'], string_split(text, ' ')) AS tokens,
         list_concat([4, 4], list_transform(string_split(text, ' '),
                                            lambda t: CAST(length(t) % 4 AS INTEGER))) AS labels
  FROM fx_rows)"""),
    "fx_seq": ([], """fx_seq AS (
  SELECT doc_id AS example_id, doc_id, lang, plen, tokens, labels,
         list_transform(labels, lambda x, i: CASE WHEN (i - 1 + doc_id) % 97 = 0 THEN 2 ELSE x END) AS output
  FROM (
    SELECT doc_id, lang, plen,
           list_transform(toks, lambda t, i: CASE WHEN i = plen THEN '[SEP]_' ELSE t END) AS tokens,
           list_transform(toks, lambda t, i: CAST(CASE WHEN i <= plen THEN 4 ELSE length(t) % 4 END AS INTEGER)) AS labels
    FROM (SELECT doc_id, lang, CAST(3 + doc_id % 3 AS INTEGER) AS plen,
                 string_split(text, ' ') AS toks
          FROM documents)))"""),
    "fx_vocab": ([], """fx_vocab_base AS (
  SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id
  FROM (SELECT DISTINCT '''' || w || '''' AS token
        FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark))),
fx_vocab AS (
  SELECT token, id FROM fx_vocab_base
  UNION ALL SELECT '''[UNK]_''' AS token, CAST(count(*) AS INTEGER) AS id FROM fx_vocab_base
  UNION ALL SELECT '''[SEP]_''' AS token, CAST(count(*) + 1 AS INTEGER) AS id FROM fx_vocab_base)"""),
    "fx_logits": ([], """fx_logits AS (
  SELECT vec_id, vec_id * 3 + (vec_id % 2) * 4 AS ordinal,
         list_transform(range(0, len(embedding)), lambda p: list_transform(range(0, 5),
             lambda c: CAST(embedding[(p + c) % len(embedding) + 1] AS DOUBLE))) AS logits,
         list_transform(range(0, len(embedding)), lambda p: CAST((vec_id + p) % 5 AS INTEGER)) AS targets
  FROM embeddings)"""),
    "fx_cands": ([], """fx_cands AS (
  SELECT CAST(item_id AS INTEGER) AS i, 'q' || CAST(item_id % 4 AS VARCHAR) AS query,
         'b/' || CAST(item_id AS VARCHAR) || '.py' AS file_path, '' AS prompt,
         CASE WHEN item_id % 7 = 0 THEN 'N/A' ELSE text END AS ans_spans,
         CASE WHEN item_id % 7 = 0 THEN 'N/A' ELSE '  ' || text || '  ' END AS ans_0,
         CASE WHEN item_id % 7 = 0 THEN 'N/A' ELSE replace(text, 'the', 'thx') END AS ans_1,
         CASE WHEN item_id % 7 = 0 THEN 'N/A' ELSE substr(text, 7) END AS ans_2,
         replace(text, 'the', 'thx') AS ans_3,
         substr(text, 13) AS ans_4,
         replace(text, 'the', 'thx') AS ans_5,
         substr(text, 19) AS ans_6,
         replace(text, 'the', 'thx') AS ans_7,
         substr(text, 25) AS ans_8,
         '   ' AS ans_9
  FROM benchmark)"""),
    "fx_pages": ([], """fx_pages AS (
  SELECT page_id, url AS code_file_path, html AS content FROM pages)"""),
    "fx_meta": ([], """fx_meta AS (
  SELECT p.pfx || CAST(n.n_nationkey AS VARCHAR) AS query_name, n.n_name AS "desc",
         r.r_name AS reccomendation, lower(n.n_name) AS folder
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN (VALUES ('src'), ('q')) AS p(pfx))"""),
}


def _closure(names):
    out = []
    def add(n):
        for dep in _FX[n][0]:
            add(dep)
        if n not in out:
            out.append(n)
    for n in names:
        add(n)
    return out


def with_fx(names, body: str, extra: str | None = None) -> str:
    """``WITH <fixture CTEs>[, extra CTEs] <body>``."""
    ctes = [_FX[n][1] for n in _closure(names)]
    if extra:
        ctes.append(extra)
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
