"""Whole queries against their DuckDB SQL, over the small tables and over tables of odd rows."""

import os

import duckdb
import pytest

from ledgerlark.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def both(spark, name, folder):
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}{'/*.parquet' if os.path.isdir(f'{folder}/{file}') else ''}'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=repr)
    return order(tuple(r[c] for c in columns) for r in got.collect()), order(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    got, want = both(spark, name, DATA)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql_on_odd_rows(spark, tmp_path, name):
    text = " ".join(f"word{i % 50}" for i in range(120))
    texts = [None, "", " \t\n", "a", text, text, "é " + text, text.replace("word7", "x y", 1), "# $ same\nsame\n\nsame", "𝒳 " * 40]
    docs = [(i, x) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    html = [None, "", "<p>menu</p><p>one <b>bold</b> &amp; more</p>", "<div>menu<br>two</div><script>menu\n</script>", "menu\r\nmenu\nthree <!-- <p>x</p> -->", "<ul><li>menu<li> \t <li>é 𝒳</ul>", "", "menu"]
    urls = [None, "", "no scheme", "http://A.org/x", "http://a.org/y?z", "http://a.org", "http://a.org/casino", "https://example.org/es/1"]
    pages = [(i, url, body) for i, (url, body) in enumerate(zip(urls, html))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    v = [float(i % 7 - 3) for i in range(64)]
    vectors = [v, v, [2 * x for x in v], [-x for x in v], None, [], [0.0] * 64, [None, *v[1:]], [float("nan"), *v[1:]], [float("inf"), *v[1:]], v[1:], [9.5, *v[1:]], [0.25] * 64, [0.25] * 63 + [0.0]]
    spark.createDataFrame(list(enumerate(vectors, 3)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, name, tmp_path)
    assert got == want
