"""Documents with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string"


def docs(spark, rows, extra="x"):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), extra) for r in rows], DOCS)


def save(df, path, name="documents"):
    df.coalesce(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def twins(letters="ab", steps=10):
    """Two different words of 2 ** steps letters, on which every polynomial hash modulo a power of two agrees."""
    bits = [bin(i).count("1") & 1 for i in range(1 << steps)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


#: Names that operators might use for columns of their own.
CLASHING = ["__n", "n_symbols", "Perplexity", "keep", "threshold", "hits", "ITEMS", "scanned", "__text", "own_id", "th", "row_", "part_", "label"]
