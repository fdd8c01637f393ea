import pathlib

import duckdb
import pytest

import __spark_entry__
from vidweave.plans import registry

ROOT = pathlib.Path(__file__).resolve().parent.parent
SMALL = pathlib.Path("/root/testdata/sf0.001")
CHEAP = ["b6_token_count", "b12_compact_text", "g1_kb_list", "g16_dedupe_assets", "e1_merge_intervals", "f8_prompt_transcript", "h4_outbox_create", "a7_parse_snapshot_json"]


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    for path in (ROOT / "vidweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "vidweave.llm" not in path.read_text() and "from .llm" not in path.read_text(), path


@pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())
