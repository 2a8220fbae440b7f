"""Registered queries against DuckDB on the smallest sample.

A cross-section runs by default; LOREKEEP_ALL=1 runs every query.
"""

import os

import pytest

from check import compare, connect
from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries

from .conftest import SF_DIR

CROSS_SECTION = """
    a01_tag_arrays a09_user_statistics a11_monthly_edits a16_category_sizes a19_keep_last a22_spam_flags
    c01_upsert c11_revision_visibility c13_archive_after_delete c14_restored c15_merged_history c16_moved_pages
    c19_renamed_tables c20_merged_users c21_tags_after c24_blocks_after c26_validation
    f02_parsed_titles f06_encodings f15_checkable g01_titles g05_attached
    j12_classified_packages j13_matching_rules l01_recentchanges l02_logevents l04_protectedtitles
    l05_allrevisions l06_alldeletedrevisions l07_allusers o04_ranked_users
    p04_revisions p09_linkshere q06_mismatched_talk q12_direct_links q24_table_differences
    r02_resolved_redirects r05_category_tree r08_contents_rows r13_completed_families r14_language_links
    s02_history_dump s08_wiki_table s12_export_changes st01_ingest st05_sessions u04_flagged_only
    w01_streaks w05_top_per_day w06_filled_race w09_value_at_events
    x04_wikilinks x06_sections x09_transclusion_closure x14_classified x16_rewritten_urls
""".split()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("LOREKEEP_ALL") else CROSS_SECTION)
def test_query_matches_sql(spark, duck, name):
    good, note = compare(spark, duck, SF_DIR, name, oracle_sql().get(name))
    assert good, note


def test_flagship_has_rows(spark):
    assert FLAGSHIP in queries()
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
