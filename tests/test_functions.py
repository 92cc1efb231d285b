from datetime import date

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.functions.dates import resolve_date
from spanloom.functions.dosing import fold_number, parse_sig
from spanloom.functions.names import name_key, names_a_form
from spanloom.functions.similarity import double_metaphone, jaro_winkler
from spanloom.operators.resolve import correction_tail, head_of_phrase

VISIT = date(2026, 9, 18)


def test_sig_fields():
    r = parse_sig("Take one 50 mg tablet once daily in the morning")
    assert (r["status"], r["dose_amount"], r["dose_unit"], r["frequency_per_day"], r["timing"]) == ("parsed", 50.0, "mg", 1.0, ["morning"])
    assert parse_sig("twice daily")["frequency_per_day"] == 2.0
    assert parse_sig("half a tablet")["dose_amount"] == 0.5
    assert parse_sig("every six hours")["frequency_per_day"] == 4.0
    assert parse_sig("for two weeks")["duration_days"] == 14
    assert parse_sig("when your ankles look puffy")["route"] is None


def test_no_dose_stated_is_not_unparseable():
    assert (parse_sig("take it as directed")["status"], parse_sig("take it as directed")["parse_confidence"]) == ("not_specified", 1.0)
    assert parse_sig("blue skies")["status"] == parse_sig("")["status"] == parse_sig(None)["status"] == "unparseable"


def test_numbers_fold():
    for words, value in (("twenty-five", 25), ("five hundred", 500), ("one thousand two hundred and fifty", 1250), ("half", 0.5), ("7.5", 7.5)):
        assert fold_number(words) == value
    assert fold_number("blue") is None


def test_dates():
    assert resolve_date("come back in three weeks", VISIT)["resolved_date"] == date(2026, 10, 9)
    assert resolve_date("come back in three weeks", VISIT)["display_string"].endswith("which is Friday, October 9")
    assert resolve_date("three weeks ago", VISIT)["resolved_date"] == date(2026, 8, 28)
    assert resolve_date("next Friday", VISIT)["resolved_date"] == date(2026, 9, 25)
    assert resolve_date("last Friday", VISIT)["resolved_date"] == date(2026, 9, 11)
    assert resolve_date("the week before your procedure", VISIT)["status"] == "unanchored"
    assert resolve_date("February 29", date(2024, 3, 1))["status"] == "unparseable"
    assert resolve_date("in March", VISIT)["range_end"] == date(2027, 3, 31)
    assert resolve_date("as needed", VISIT)["status"] == "not_a_date"
    assert resolve_date(None, VISIT)["status"] == resolve_date("x", None)["status"] == "unparseable"


@given(st.text(alphabet="abcXL -,.'é1 mgtablet", max_size=30))
@settings(max_examples=150, deadline=None)
def test_name_keys_are_stable(raw):
    k = name_key(raw)
    assert name_key(k.key).key == k.key


def test_name_keys():
    assert name_key("the Toprol-XL 50 mg tablet") == ("toprol-xl", "toprol-xl", "toprol", "xl")
    assert name_key("Metoprolol Succinate ER").salt_key == "metoprolol er"
    assert name_key("sodium chloride").salt_key == "sodium chloride"
    assert name_key(None).key == "" and names_a_form("my water pill") and not names_a_form("pill")


@given(st.text(alphabet="abcde", max_size=9), st.text(alphabet="abcde", max_size=9))
@settings(max_examples=150, deadline=None)
def test_jaro_winkler_is_duckdbs(a, b):
    if a and b:
        assert abs(jaro_winkler(a, b) - duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9


def test_metaphone_and_phrase_heads():
    assert double_metaphone("metropolol")[0] == "MTRPLL" and double_metaphone("metoprolol")[0] == "MTPRLL"
    assert double_metaphone("") == ("", "")
    assert head_of_phrase("metoprolol up to 50 milligrams") == "metoprolol"
    assert correction_tail("the lyso, ly, lysinop, lysinopril") == "lysinopril" and correction_tail("metoprolol, lisinopril") is None
