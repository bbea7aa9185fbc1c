"""Listings are parsed once, whatever is asked of them."""

from __future__ import annotations

from stowage.operators import remote as R
from stowage.sources.listings import listing_entries, listing_problems, parse_listings

_GOOD = '{"files":[{"text":"b","leaf":false},{"TEXT":"a.raw","size":"5"},{"text":""},]}'


def listed(rows):
    return parse_listings(rows("folder string, value string", ("/x/", _GOOD), ("/y/", "<html>"), ("/z/", '{"files":[]}'),
                               ("/v/", "{}"), ("/w/", None)))


def parses(df) -> int:
    """How often the plan reads JSON: once for a document and once for its entries."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json")


def test_conditions_on_entries_do_not_parse_again(rows):
    parsed = listed(rows)
    folders = listing_entries(parsed).where("is_collection AND NOT startswith(name, '.')")
    assert parses(parsed) == parses(listing_entries(parsed)) == parses(folders) == parses(listing_problems(parsed)) == 2
    assert sorted((r.folder, r.name, r.is_collection, r.length) for r in listing_entries(parsed).collect()) == [
        ("/x/", "a.raw", False, 5), ("/x/", "b", True, 0)]
    assert sorted(r.folder for r in listing_problems(parsed).collect()) == ["/v/", "/w/", "/y/"]


def test_sorted_folders_are_parsed_before_the_sort(rows):
    found = R.writable_folders(listing_entries(listed(rows)))
    assert parses(found) == 0 and [(r.folder, r.name, r.can_upload) for r in found.collect()] == [("/x/", "b", False)]


def test_sorted_listing_is_parsed_before_the_sort(rows):
    found = R.listing_order(listing_entries(listed(rows)))
    assert parses(found) == 0 and [(r.kind, r.name, r.size) for r in found.collect()] == [("DIR", "b", ""), ("FILE", "a.raw", "5 B")]
