"""Hand-made rows for the text dialects."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtside.functions import dates, labels, scores, text


def L(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize("raw,want", [("José Ñuñez", "jose nunez"), ("Løkke ß æ", "løkke ß æ"), ("ÀÉÎÕÜ", "aeiou"), (None, "")])
def test_fold(one, raw, want):
    assert one(text.fold(L(raw))) == want


def test_fold_combining_marks(one):
    assert one(text.fold(F.lit("José"))) == "jose"


def test_slug(one):
    assert one(text.slug(F.lit("  Isla de La Palma – Open! "))) == "isla-de-la-palma-open"
    assert one(text.slug(F.lit("A. B-C"), "")) == "abc"


@pytest.mark.parametrize("cell,want", [("66", 6), ("75", 7), ("7", 7), ("10", 10), ("", 0), ("6(5)", 6), ("x", 0), ("0", 0)])
def test_games(one, cell, want):
    assert one(scores.games(L(cell))) == want


def test_set_parts(one):
    assert tuple(one(scores.set_parts(L("75")))) == ("7", "5", "7(5)")
    assert tuple(one(scores.set_parts(L("10")))) == ("10", None, "10")


@pytest.mark.parametrize("raw,dialect,want", [
    ("6–1 / 7–6[3]", "season", ["6-1", "7-6"]), ("4-6, 6-2 y 7-5", "season", ["4-6", "6-2", "7-5"]), ("6-1 and 7-6(5)", "season", ["6-1", "7-6"]),
    ("6-1/7-6(4) x6-0", "circuit", ["6-1", "7-6"]), ("6-4 3-0 ab.", "news", ["6-4", "3-0"]), ("7-6(5) W/O", "news", ["7-6"]),
    ("6-4,6-3 wo", "bracket", ["6-4", "6-3"]), ("", "bracket", []), ("walkover", "circuit", []),
])
def test_parse_sets(one, raw, dialect, want):
    assert [f"{r['a']}-{r['b']}" for r in one(scores.parse_sets(L(raw), dialect))] == want


@pytest.mark.parametrize("raw,want", [
    ("7/6 6 / 3", "7-6 6-3"), ("6/4 abandono", "6-4 ab."), ("6/0 6/0 W.O.", "6-0 6-0 wo"), ("sin datos", None),
])
def test_bracket_score(one, raw, want):
    assert one(scores.bracket_score(L(raw))) == want


@pytest.mark.parametrize("raw,want", [("7/6 6/3", True), ("mie 25/3 10.30", False), ("10:30", False), ("", False), ("miguel 6/3", True)])
def test_is_bracket_score(one, raw, want):
    assert one(scores.is_bracket_score(L(raw))) is want


def test_pair_cells(one):
    sets = one(scores.pair_cells(F.array(L("6"), L("-"), L("7")), F.array(L("4"), L("-"))))
    assert [(r["a"], r["b"]) for r in sets] == [("6", "4"), ("7", "")]


@pytest.mark.parametrize("won,lost,want", [(1, 1, 50), (1, 7, 13), (0, 0, None), (1, 199, 1)])
def test_percent(one, won, lost, want):
    assert one(scores.percent(F.lit(won), F.lit(lost))) == want


@pytest.mark.parametrize("raw,want", [
    ("Quarterfinals", 80), ("Semi Final", 90), ("FINAL", 100), ("Finale", 100), ("Semifinales", 90), ("3rd place final", 85), ("Platz 5", 85),
    ("Round of 16", 70), ("Åttendelsfinal", 70), ("R32", 60), ("1/32", 50), ("Runde 1", 40), ("Pool A", 20), ("Q1", 15), ("Öst", 30), (None, 30),
    ("Finalist", 30),
])
def test_round_rank(one, raw, want):
    assert one(labels.round_rank(L(raw))) == want


@pytest.mark.parametrize("raw,want", [("Final", True), ("Finals", True), ("Semi final", False), ("1/4 final", False), ("Quarterfinals", False), (None, False)])
def test_is_final(one, raw, want):
    assert one(labels.is_final_round(L(raw))) is want


@pytest.mark.parametrize("raw,want", [
    ("1° ronda previa", "Qualifying"), ("Cuarta ronda", "Qualifying"), ("16º", "Round of 32"), ("8 º", "Round of 16"), ("1 / 4", "Quarterfinal"),
    ("Semifinal", "Semifinal"), ("Final", "Final"), ("Ana Garcia", None),
])
def test_draw_round(one, raw, want):
    assert one(labels.draw_round(L(raw))) == want


@pytest.mark.parametrize("raw,year,want", [
    ("7 February – 14 February", 2026, ("2026-02-07", "2026-02-14")), ("28 December - 3 January", 2026, ("2026-12-28", "2027-01-03")),
    ("5 December", 2026, ("2026-12-05", "2026-12-05")), ("Postponed", 2026, None), ("TBC", 2026, None), ("31 Foo – 2 Bar", 2026, None),
])
def test_date_range(one, raw, year, want):
    got = one(dates.date_range(L(raw), F.lit(year)))
    assert (got and (str(got["start"]), str(got["end"]))) == want


@pytest.mark.parametrize("raw,locale,want", [
    ("Cup 12.07.2026 – 14.07.2026", "no", ["2026-07-12", "2026-07-14"]), ("3 mai 2026", "no", ["2026-05-03"]), ("12 July 2026 to 1 Sept 2026", "en", ["2026-07-12", "2026-09-01"]),
    ("1/2/2026 or 3 March 2026", "en", ["2026-02-01"]), ("soon", "en", []),
])
def test_first_dates(one, raw, locale, want):
    assert [str(d) for d in one(dates.first_dates(L(raw), locale))] == want


def test_season_start_spanish(one):
    assert one(dates.season_start(L("23 de marzo al 29 de marzo"), F.lit(2014))) == dt.date(2014, 3, 23)
    assert one(dates.season_start(L("30 de febrero"), F.lit(2014))) is None


@pytest.mark.parametrize("raw,want", [("Not before 3:00 PM", 900), ("12:05 am", 5), ("12:30 PM", 750), ("14:45", 885), ("Followed by", None)])
def test_clock(one, raw, want):
    assert one(dates.clock_minutes(L(raw))) == want


def test_format_minutes_keeps_half_minutes(one):
    assert one(dates.format_minutes(F.lit(582.5))) == "09:42.5"
    assert one(dates.format_minutes(F.lit(1445.0))) == "00:05"


@pytest.mark.parametrize("label,today,want", [
    ("JUL 16 THU", "2026-07-20", "2026-07-16"), ("DEC 31 WED", "2026-01-02", "2025-12-31"), ("JAN 1 FRI", "2026-12-30", "2027-01-01"),
    ("JAN 1", "2026-12-30", "2027-01-01"), ("JUL 16 MON", "2026-07-20", "2026-07-16"),
])
def test_day_label(one, label, today, want):
    assert str(one(dates.day_label_date(L(label), L(today).cast("date")))) == want


def test_iso_week_of_year_edges(one):
    assert one(dates.iso_week(L("2027-01-01").cast("date"))) == "2026-W53"
    assert one(dates.iso_week(L("2024-12-30").cast("date"))) == "2025-W01"


@pytest.mark.parametrize("lines,want", [
    (["1", "Ana Sol (esp)", "Bea Mar", "(esp-arg)"], ["Ana Sol", "Bea Mar"]), (["P Navarro/B Ramírez"], ["P Navarro", "B Ramírez"]),
    (["2. Ana", "BYE"], ["Ana"]), (["Exento"], []),
])
def test_pair_from_lines(one, lines, want):
    assert one(text.pair_from_lines(F.array(*[L(x) for x in lines]))) == want


@pytest.mark.parametrize("p,q,want", [
    (["Sanyo Gutiérrez", "Juani Mieres"], ["Carlos Daniel Gutierrez", "Juan Mieres Petruf"], True),
    (["Juani Mieres", "Sanyo Gutiérrez"], ["Carlos Daniel Gutierrez", "Juan Mieres Petruf"], True),
    (["Maxi Sanchez", "Ana Sol"], ["Maximiliano Other", "Ana Sol"], False), (["Ana Sol"], ["Ana Sol"], False),
])
def test_same_pair(one, p, q, want):
    assert one(text.same_pair(F.array(*map(L, p)), F.array(*map(L, q)))) is want


def test_split_pair_and_labels(one):
    assert one(text.split_pair(L("Ana Sol y Bea Mar[3]"))) == ["Ana Sol", "Bea Mar"]
    assert one(text.player_label(L("Kai Berg (C) [1, DA]"))) == "Kai Berg"
    assert one(text.undouble(L("España  España"))) == "España"


@pytest.mark.parametrize("head,cls,rnd", [("Herrer A Runde 2", "Herrer A", "Runde 2"), ("Men Semifinals", "Men", "Semifinals"), ("Open class", "Open class", None)])
def test_header_split(one, head, cls, rnd):
    got = one(labels.split_header(L(head)))
    assert (got["class_name"], got["round"]) == (cls, rnd)


def test_label_functions_for_movement(one):
    f = lambda state, delta: one(labels.movement_label(F.lit(True), L(state), F.lit(delta).cast("int")))
    assert [f("new", None), f("up", 3), f("down", -2), f("same", 0), f("untracked", None)] == ["NEW", "▲3", "▼2", "–", "·"]
