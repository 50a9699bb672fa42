"""Long runs, and that no chunk is left out."""

import pytest

from tests.oracle import connect
from veldra.operators import context
from veldra.plans import registry
from veldra.plans.common import current_sql

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_long_runs_and_gaps(spark):
    rows = [("d", "s", i, f"c{i}", 10 * i, 10 * i + 12, f"{i:02d}" + "x" * 8 + f"{i + 1:02d}", i == 4, i) for i in (*range(9), *range(10, 12))]
    chunks = spark.createDataFrame(rows, "doc_path string, section_id string, ordinal int, chunk_id string, char_start int, char_end int, text string, selected boolean, priority int")
    got = context.passages(chunks, "doc_path", "section_id").collect()
    assert [(r.first_ordinal, r.chunks, r.char_start, r.char_end, r.priority) for r in got] == [(0, 9, 0, 92, 4)]
    assert got[0].text == "".join(f"{i:02d}" + "x" * 8 for i in range(9)) + "09"


def test_every_chunk_is_in_a_block(spark, con, folder):
    whole = con.execute(f"select count(*) from {current_sql('chunks', 'chunk_id')} where doc_path is not null").fetchone()[0]
    assert sum(r.chunks for r in QUERIES["prompt_blocks"](spark, folder).select("chunks").collect()) == whole
