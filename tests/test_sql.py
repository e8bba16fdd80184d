"""Queries against their DuckDB twins on tables that the given ones don't hold."""

import duckdb

from palimpsest import plans


def both(spark, folder, name, **tables):
    """Sorted rows of Spark and of DuckDB over tables (rows, schema), written to the folder."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = plans.QUERIES[name](spark, str(folder))
    found = c.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_quotes_stand_as_they_are_spelt(spark, tmp_path):
    """A place that differs in white space or signs comes only where the quote itself stands nowhere."""
    said = "we saw it in the long run of it all"
    texts = [
        said.replace(" ", "\n") + " " + said,
        said.replace(" ", "  ") + "\n" + said + " " + said,
        "it’s so – it's so - it’s so – it's so - as we know it's so - indeed",
        "　" * 40,
        " " * 40,
        "　a" * 40,
        "a\fb" * 30,
        " one two" * 20 + "one two" * 20,
        "\f x\x0b y" * 30,
        "😀 é x" * 20,
        "",
        None,
    ]
    rows = [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(60)]
    ours, theirs = both(spark, tmp_path, "find_quote", documents=(rows, "doc_id long, text string"))
    assert ours == theirs and len(ours) > 250
