"""Joins (C1-C9).  No join is hinted: the planner and AQE broadcast a dimension side by its
size in bytes, and otherwise use a shuffle join (with AQE skew splitting)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.sequences import SEP_TOKEN, UNK_TOKEN

# the vocabulary is shipped to the workers only below both bounds
MAP_VOCAB_ROWS = 500_000
MAP_VOCAB_BYTES = 32 << 20


ON_MISS = ("keep", "drop", "fail")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], check: str, on_miss: str = "keep") -> DataFrame:
    """``left`` with the columns of ``right`` by equal keys; ``right`` holds a key once.

    A key without a match is an error of the data.  One left join finds it, and ``on_miss`` says
    what becomes of the row: ``keep`` - it stays, with the name of the ``check`` in ``missing``
    (the first one that failed, over several lookups; null: none), for ``found`` and ``rejects``;
    ``drop`` - it goes; ``fail`` - reading any looked-up column of it stops the job with the
    check and the key, before a writer commits.  A null key has no match."""
    if on_miss not in ON_MISS:
        raise ValueError(on_miss)
    if on_miss == "drop":
        return left.join(right, keys, "inner")
    new = [c for c in right.columns if c not in keys]
    joined = left.join(right.withColumn("_hit", F.lit(True)), keys, "left")
    if on_miss == "fail":
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        stop = F.raise_error(F.concat(F.lit(f"{check}: no matching row for "), key))
        for c in new:
            joined = joined.withColumn(c, F.when(F.col("_hit").isNull(), stop).otherwise(F.col(c)))
        return joined.drop("_hit")
    before = F.col("missing") if "missing" in left.columns else F.lit(None).cast("string")
    return joined.withColumn("missing", F.coalesce(before, F.when(F.col("_hit").isNull(), check))).drop("_hit")


def found(joined: DataFrame) -> DataFrame:
    """The rows of ``lookup`` whose keys all had a match."""
    return joined.where("missing IS NULL").drop("missing")


def rejects(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Violation rows (check, key, detail) for the rows of ``lookup`` without a match."""
    return joined.where("missing IS NOT NULL").select(
        F.col("missing").alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        F.lit("no matching row").alias("detail"))


def join_query_meta(ex: DataFrame, meta: DataFrame, on_miss: str = "keep") -> DataFrame:
    """Attach description and recommendation by query name (``lookup``)."""
    return lookup(ex, meta.select("query_name", "desc", "reccomendation"), ["query_name"], "query_meta", on_miss)


def join_source_text(ex: DataFrame, files: DataFrame, on_miss: str = "keep") -> DataFrame:
    """Attach the file text by path (shuffle join on the path: both sides grow; ``lookup``)."""
    return lookup(ex, files.select("code_file_path", "content"), ["code_file_path"], "source_text", on_miss)


def vocab_encode(df: DataFrame, vocab: DataFrame, key: str, tokens_col: str, out_col: str = "ids",
                 strategy: str = "auto") -> DataFrame:
    """Token -> id through the vocabulary; the lookup key is the token in single
    quotes; a miss takes the id of the quoted unknown token.

    ``strategy``:
    * ``"map"`` - the vocabulary (at most ``MAP_VOCAB_ROWS`` entries and ``MAP_VOCAB_BYTES``
      bytes of tokens, measured before anything is collected) is
      broadcast once as a hash map and each token array is mapped in Arrow batches:
      a narrow operator, no shuffle of the (large) token side at all.
    * ``"join"`` - rows are dealt into blocks where they stand; each block's distinct tokens
      are looked up with a join, and the ids come back by a join of bucketed tables: tokens
      are shuffled once per block, rows never.
    * ``"auto"`` - ``map`` when the vocabulary is within the bounds, else ``join``.

    Both give the same rows: one per input row whatever its key, null token arrays stay
    null, a null token is a miss, and a token listed twice takes its largest id.

    The map strategy is opaque to the optimizer, so every input column passes through
    Arrow: select the key, the tokens and only the columns needed downstream first."""
    if strategy not in ("auto", "map", "join"):
        raise ValueError(strategy)
    if strategy in ("auto", "map"):
        size = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("b")).first()
        if size["n"] <= MAP_VOCAB_ROWS and (size["b"] or 0) <= MAP_VOCAB_BYTES:
            return _encode_map(df, vocab.select("token", "id").collect(), tokens_col, out_col)
        if strategy == "map":
            raise ValueError("vocabulary too large to ship: use the join strategy")
    return _encode_join(df, vocab, tokens_col, out_col)


def _encode_map(df: DataFrame, rows: list, tokens_col: str, out_col: str) -> DataFrame:
    """Vectorized lookup in Arrow: the token list column of each batch is flattened and
    dictionary-encoded, each distinct token is looked up once in the broadcast vocabulary,
    misses take the unknown id, and the ids are re-wrapped with the same list offsets."""
    from pyspark.sql import types as T
    table = {}
    for r in rows:  # the lookup key is the token inside single quotes
        t = r["token"]
        if t is not None and len(t) >= 2 and t[0] == "'" and t[-1] == "'":
            table[t[1:-1]] = max(r["id"], table.get(t[1:-1], r["id"]))
    unk = table.get(UNK_TOKEN)
    from spanlake.session import ensure_library_on_workers
    ensure_library_on_workers(df.sparkSession)
    bc = df.sparkSession.sparkContext.broadcast((table, unk))
    schema = T.StructType([f for f in df.schema.fields if f.name != out_col]
                          + [T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        ids, unk_id = bc.value
        for b in batches:
            toks = b.column(tokens_col)
            if isinstance(toks, pa.ChunkedArray):
                toks = toks.combine_chunks()
            words = toks.flatten().dictionary_encode()
            found = pa.array([ids.get(w, unk_id) for w in words.dictionary.to_pylist()], pa.int32())
            enc = pc.take(found, words.indices)
            if unk_id is not None:
                enc = pc.fill_null(enc, pa.scalar(unk_id, pa.int32()))
            offsets = toks.offsets
            if toks.offset:
                offsets = pc.subtract(offsets, offsets[0])
            lists = pa.ListArray.from_arrays(offsets, enc, mask=toks.is_null())
            cols = [b.column(n) for n in names[:-1]] + [lists]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


#: A block of the join form: rows of at most so many tokens (or one row).
BLOCK_TOKENS = 1 << 16


def _blocks(tokens_col: str, block_tokens: int):
    """Batches as block rows: the rows of a block as structs, each with the positions of its
    tokens in the block's dictionary, and the dictionary."""
    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in batches:
            toks = b.column(tokens_col)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(toks), 0)).astype(np.int64)
            of = np.cumsum(sizes) // block_tokens
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                lists = part.column(tokens_col)
                words = lists.flatten().dictionary_encode()
                offsets = pc.subtract(lists.offsets, lists.offsets[0]) if lists.offset or i else lists.offsets
                at = pa.ListArray.from_arrays(offsets, pc.cast(words.indices, pa.int32()), mask=lists.is_null())
                rows = pa.StructArray.from_arrays([*part.columns, at], names=[*part.schema.names, "_at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), rows),
                     pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), pc.cast(words.dictionary, pa.string()))],
                    names=["_block", "_rows", "_words"])

    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` stored as a table bucketed by ``_block`` in the scratch folder."""
    import os

    from spanlake.session import scratch_dir
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    table = "spanlake_" + os.path.basename(path).replace("-", "_")
    df.write.bucketBy(buckets, "_block").option("path", path).saveAsTable(table)
    return spark.table(table)


def _encode_join(df: DataFrame, vocab: DataFrame, tokens_col: str, out_col: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows are dealt into blocks where they stand, a block keeps the positions of its tokens in
    its own dictionary, and only dictionaries meet the vocabulary.  Their ids come back as one
    array per block, by a join of two tables bucketed alike: no row and no token occurrence is
    shuffled, and a frequent word comes once per block."""
    from pyspark.sql import types as T

    from spanlake.session import ensure_library_on_workers
    ensure_library_on_workers(df.sparkSession)
    unk = token_id(vocab, UNK_TOKEN)
    v = vocab.groupBy(F.col("token").alias("_qtok")).agg(F.max("id").alias("_id"))
    df = df.drop(out_col)
    row = T.StructType([*df.schema.fields, T.StructField("_at", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("_block", T.StringType()), T.StructField("_rows", T.ArrayType(row)),
                           T.StructField("_words", T.ArrayType(T.StringType()))])
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _bucketed(df.mapInArrow(_blocks(tokens_col, block_tokens), schema), "vocab-blocks", buckets)
    words = blocks.select("_block", F.posexplode("_words").alias("_pos", "_tok"))
    hit = (words.withColumn("_qtok", F.concat(F.lit("'"), F.col("_tok"), F.lit("'"))).join(v, "_qtok", "left")
           .select("_block", "_pos", F.coalesce(F.col("_id"), F.lit(unk)).cast("int").alias("_id")))
    ids = _bucketed(hit.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_pos", "_id"))).alias("_e"))
                    .select("_block", F.transform("_e", lambda x: x["_id"]).alias("_ids")), "vocab-ids", buckets)
    joined = blocks.select("_block", "_rows").join(ids, "_block", "left")
    encoded = F.transform("_rows", lambda r: F.struct(
        *[r[c].alias(c) for c in df.columns],
        F.transform(r["_at"], lambda i: F.coalesce(F.get(F.col("_ids"), i), F.lit(unk).cast("int"))).alias(out_col)))
    return joined.select(F.inline(encoded))


def token_id(vocab: DataFrame, token: str) -> int | None:
    """Id of one special token (a single scalar read back from the vocabulary)."""
    row = vocab.where(F.col("token") == f"'{token}'").agg(F.max("id").alias("id")).first()
    return None if row is None else row["id"]


def sep_id(vocab: DataFrame) -> int | None:
    return token_id(vocab, SEP_TOKEN)


def join_folder_map(df: DataFrame, meta: DataFrame, col: str = "query_name", on_miss: str = "keep") -> DataFrame:
    """C4: query -> output folder (``lookup``)."""
    return lookup(df, meta.select(F.col("query_name").alias(col), "folder"), [col], "folder_map", on_miss)


def join_sample_examples(sample: DataFrame, ex: DataFrame) -> DataFrame:
    """Every example row of each sampled (query, file)."""
    return sample.join(ex, ["query_name", "code_file_path"], "left")


def join_few_shot(sample: DataFrame, shots: DataFrame) -> DataFrame:
    """Attach the per-query few-shot values (two rows per query at most)."""
    # at most two rows per query: AQE turns this into a broadcast join from the measured size
    return sample.join(shots, "query_name", "left")


def join_relevance_pred(blocks: DataFrame, preds: DataFrame) -> DataFrame:
    """Block predictions aligned by (query, file, block ordinal)."""
    return blocks.join(preds, ["query_name", "code_file_path", "block_ordinal"], "inner")


def semi_join_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose (query, path) is in a derived list."""
    return df.join(files.select("query_name", "code_file_path").distinct(),
                   ["query_name", "code_file_path"], "left_semi")


def join_pred_target(targets: DataFrame, outputs: DataFrame, key: str = "example_id") -> DataFrame:
    """Target and output sequences paired by example id."""
    return targets.join(outputs, key, "inner")
