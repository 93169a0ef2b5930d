"""Every query has a table behind it, and those with SQL give the same rows."""

import pytest

import __spark_entry__ as entry
from tests import oracle

TINY = "/root/testdata/sf0.001"
SOME = (
    "f_kebab f_replace_regex f_calc f_date f_duration f_nth_basis f_map_template f_wikilink f_strip_attr tl_if_elseif tl_for_loop tl_nullish route_first_match route_table "
    "prop_type_join frontmatter usage_weekly_sunday highlight_merge highlight_overlaps domain_rollup cue_chapter_join cue_leftovers nearest_name audit_lattice field_profile_top5 heading_numbering block_walk stream_daily"
).split()


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["src_table", "rec_id", "utc_ms"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return oracle.connection(TINY)


def test_against_sql(spark, con):
    assert {n: why for n in SOME if (why := oracle.compare(spark, con, n, TINY))} == {}
