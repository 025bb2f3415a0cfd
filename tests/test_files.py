"""Files as memories: a table of odd pages against the SQL, and the rows of long pages that the SQL does not have."""

from hashlib import sha256

import duckdb
import pytest

import __spark_entry__ as entry

SIZE, OVERLAP = 80_000, 2_000
PAGES = [
    ("https://a/1", "<p>x</p>"), ("https://a/1", "<p>x</p>"), ("https://a/1", "other"), ("https://a/2", ""), ("https://a/3", None),
    (None, "no name"), (None, ""), (None, None), ("", "empty name"), ("a|b/ \n", "r\r\nn\x00 \U0001f600"),
    ("https://a/4", "c" * SIZE), ("https://a/5", "é" * (SIZE // 2)),
    ("https://a/6", "c" * (SIZE + 1)), ("https://a/7", "é" * (SIZE // 2 + 1)), (None, "".join(f"{i}\n" for i in range(40_000))),
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Rows of the query, and those of its SQL."""
    folder = tmp_path_factory.mktemp("odd")
    table = spark.createDataFrame([(i, *page) for i, page in enumerate(PAGES)], "page_id long, url string, html string")
    table.write.parquet(f"{folder}/pages.parquet")
    columns = ["id", "content", "category", "memory_type", "tags", "source"]
    made = [tuple(r) for r in entry.queries()["files_to_memories"](spark, str(folder)).select(columns).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return made, con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['files_to_memories']})").fetchall()


def test_files_without_a_name_have_the_rows_of_the_sql(rows):
    """A missing name dropped out of the id and the tags, and the source was null."""
    made, wanted = rows
    assert sorted(r for r in made if r in wanted) == sorted(wanted)


def test_long_pages_are_kept_whole(rows):
    """What the query has beyond its SQL is all chunks of the pages above 80,000 bytes, and nothing else."""
    rest = list(rows[0])
    for row in rows[1]:
        rest.remove(row)
    for url, html in PAGES:
        text = (html or "").encode()
        if len(text) <= SIZE:
            continue
        end, number = 0, 0
        while end < len(text):
            key = sha256(f"file/tenant-1/{url or ''}/{number}".encode()).hexdigest()
            [row] = [r for r in rest if r[0] == key]
            rest.remove(row)
            chunk = row[1].encode()
            start = next(at for at in range(max(end - OVERLAP - 3, 0), end + 1) if text.startswith(chunk, at) and at + len(chunk) > end)
            end, number = start + len(chunk), number + 1
            assert len(chunk) <= SIZE
            assert row[2:] == ("entities", "session", f"file:{url or ''}|chunk_type:text", f"file_upload:{url or ''}")
        assert end == len(text) and number > 1
    assert rest == []
