"""A small world for the as-of tests, made by rule and by a seeded generator, with its own answers.

Six seasons of five games between two clubs, one of them long; thirty players who play, miss games and
move at random; a cup, a European and a foreign competition. ``expected_features`` works out every
answer in plain Python, row by row, so no expected number is written down.
"""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from pitlake.operators import asof as A
from pitlake.operators import cleaning as K
from pitlake.operators import labels as L
from pitlake.operators import seasons as T

GAMES = 5
SEASONS = list(range(2004, 2010))
LONG = 2006  # its last game is played in August
STUDY = [2006, 2007, 2008, 2009]
MIN_MINUTES = 100.0
LABELS = {"GK": "Goalkeeper", "DF": "Left-Back", "MF": "Midfield", "FW": "Second Striker"}
PROFILES = {"GK": "Goalkeeper", "DF": "Defender", "MF": "Midfield", "FW": "Attack"}


def game_days(season: int) -> list[dt.date]:
    days = [dt.date(season, 9, 3 + season % 4) + dt.timedelta(days=51 * i) for i in range(GAMES)]
    return [*days[:-1], dt.date(season + 1, 8, 6)] if season == LONG else days


FIRST = {s: game_days(s)[0] for s in SEASONS}
LAST = {s: game_days(s)[-1] for s in SEASONS}
START, END, TEST_START = (str(LAST[s] + dt.timedelta(days=1)) for s in (STUDY[0] - 1, STUDY[-1], STUDY[-2]))


def day(text: str):
    return F.lit(text).cast("date")


def expected_lookback(on: dt.date):
    done = sorted((s for s in SEASONS if LAST[s] < on), reverse=True)[:2]
    now = [s for s in SEASONS if FIRST[s] < on <= LAST[s]]
    return (*done, *[None] * (2 - len(done)), now[0] if now else None, len(done) == 2)


class Snapshot:
    def __init__(self, spark):
        self.spark = spark
        rng = random.Random(20)
        league = [(f"g{s}-{i}", s, d) for s in SEASONS for i, d in enumerate(game_days(s))]
        score = {g: (s % 3, i % 2) for i, (g, s, _) in enumerate(league)}
        games = [(g, "HOME", str(s), str(d), "c1", "c2", float(score[g][0]), float(score[g][1])) for g, s, d in league]
        self.abroad = [(f"x{k}", rng.choice(["EUR", "FOR", "CUP"]), dt.date(2005, 1, 1) + dt.timedelta(days=rng.randrange(2000))) for k in range(40)]
        games += [(g, c, str(d.year), str(d), "c1", "c9", 1.0, 1.0) for g, c, d in self.abroad]
        self.plays, self.moved, self.worth = [], [], []
        people, lineups = [], []
        for p in range(30):
            pid, group = f"p{p}", rng.choice(list(PROFILES))
            profile = "Unknown" if p == 4 else PROFILES[group]
            people.append((pid, f"Person {p}", f"{1975 + p % 12}-0{1 + p % 9}-1{p % 9} 00:00:00", profile))
            for g, s, d in league:
                if p != 5 and rng.random() < (0.1 if p % 6 == 1 else 0.8):
                    self.plays.append((g, pid, s, d, "HOME", rng.choice(["c1", "c2"]), rng.randrange(4), rng.randrange(3), rng.choice([0, 15, 45, 90])))
                    if p not in (3, 4) and rng.random() < 0.9:
                        lineups.append((g, pid, LABELS[rng.choice([group, group, rng.choice(list(LABELS))])]))
            for g, c, d in self.abroad:
                if rng.random() < 0.3:
                    self.plays.append((g, pid, None, d, c, "c1", rng.randrange(3), 0, rng.choice([30, 90])))
            special = [LAST[LONG], FIRST[2008], dt.date(2007, 7, 1)] if p % 7 == 0 else []
            for k, d in enumerate([*special, *(dt.date(2004, 6, 1) + dt.timedelta(days=rng.randrange(2300)) for _ in range(4))]):
                fee = rng.choice([None, "?", "0.00", "junk", *(str(250_000.0 * rng.randrange(1, 90)) for _ in range(8))])
                self.moved.append((len(self.moved), pid, str(d), "x", f"c{1 + k % 2}", f"c{k % 3}", "A", "B", fee))
            for _ in range(rng.randrange(5)):
                self.worth.append((pid, dt.date(2005, 1, 1) + dt.timedelta(days=rng.randrange(2000)), 1e5 * rng.randrange(1, 300)))
        self.lineup_of = {(g, p): next(k for k, v in LABELS.items() if v == label) for g, p, label in lineups}
        self.profile_of = {p: next((k for k, v in PROFILES.items() if v == x), None) for p, _, _, x in people}
        self.born = {p: dt.date.fromisoformat(b[:10]) for p, _, b, _ in people}
        self.points_of = {g: {"c1": 3 if a > b else a == b, "c2": 3 if b > a else a == b} for g, (a, b) in score.items()}

        make = spark.createDataFrame
        self.raw_games = make(
            games,
            "game_id string, competition_id string, season string, date string, home_club_id string, "
            "away_club_id string, home_club_goals double, away_club_goals double",
        )
        self.raw_apps = make(
            [tuple(str(x) for x in (f"{g}/{p}", g, p, club, c, d, goals, assists, minutes, 0, 0))
             for g, p, _, d, c, club, goals, assists, minutes in self.plays],
            "appearance_id string, game_id string, player_id string, player_club_id string, "
            "competition_id string, date string, goals string, assists string, minutes_played string, "
            "yellow_cards string, red_cards string",
        )
        self.raw_lineups = make(lineups, "game_id string, player_id string, position string")
        self.raw_players = make(people, "player_id string, name string, date_of_birth string, position string")
        self.raw_moves = make(
            self.moved,
            "source_row int, player_id string, transfer_date string, transfer_season string, "
            "from_club_id string, to_club_id string, from_club_name string, to_club_name string, "
            "transfer_fee string",
        )
        self.raw_values = make([(p, str(d), v) for p, d, v in self.worth], "player_id string, date string, market_value_in_eur double")
        self.competitions = make(
            [("HOME", "home-league", "domestic_league"), ("CUP", "home-cup", "domestic_cup"),
             ("EUR", "continental", "international_cup"), ("FOR", "foreign-league", "domestic_league")],
            "competition_id string, competition_code string, type string",
        )
        self.games = K.clean_games(self.raw_games, ["HOME"]).cache()
        self.appearances = K.clean_appearances(self.raw_apps, self.games)[1].cache()
        self.lineups = K.clean_lineups(self.raw_lineups, self.games).cache()
        self.players = K.clean_players(self.raw_players).cache()
        self.moves = K.clean_transfers(self.raw_moves).drop("copies").cache()
        self.values = K.clean_valuations(self.raw_values)
        self.seasons = T.season_table(self.games, GAMES).cache()
        self.reasoned = L.with_label_reason(self.moves, day(START), day(END)).cache()
        self.labels = L.labels(self.reasoned).cache()
        self.candidates = self.features_for(self.labels).cache()
        self.features = A.usable_features(self.candidates).cache()

    def features_for(self, candidates, appearances=None):
        return A.feature_candidates(
            candidates, appearances if appearances is not None else self.appearances, self.lineups,
            self.players, self.seasons, SEASONS, MIN_MINUTES,
        )

    def seen(self, player: str, on: dt.date):
        """League rows of the lookback, before the cutoff."""
        wanted = {s for s in expected_lookback(on)[:3] if s}
        return [r for r in self.plays if r[1] == player and r[2] in wanted and r[3] < on]

    def expected_features(self, player: str, on: dt.date) -> dict:
        rows, (one, two, now, ok) = self.seen(player, on), expected_lookback(on)
        minutes, goals = sum(r[8] for r in rows), sum(r[6] for r in rows)
        labels = [self.lineup_of[r[0], player] for r in rows if (r[0], player) in self.lineup_of]
        mode = max(PROFILES, key=lambda k: (labels.count(k), -list(PROFILES).index(k))) if labels else None
        born = self.born[player]
        reason = (
            "incomplete_lookback" if not ok else "no_rows" if not rows else "few_minutes" if minutes < MIN_MINUTES
            else "no_position" if not (mode or self.profile_of[player]) else None)
        share = sum(d < on for d in game_days(now)) / GAMES if now else 0.0
        start = FIRST[two] if two else None
        outside = [r for r in self.plays if r[1] == player and start and start <= r[3] < on]
        points = [self.points_of[r[0]][r[5]] for r in rows if r[8] > 0]
        return {
            "reason": reason, "goals": goals, "minutes": minutes, "matches": len(rows), "last": max((r[3] for r in rows), default=None),
            "position": mode or self.profile_of[player], "proxy": mode is None and self.profile_of[player] is not None,
            "age": on.year - born.year - ((on.month, on.day) < (born.month, born.day)),
            "goals_per90": 90 * goals / minutes if minutes >= MIN_MINUTES else None,
            "equivalents": 2 + share, "share": share, "window": "in_season" if now else "off_season", "start": start,
            "europe": sum(r[8] for r in outside if r[4] == "EUR"), "foreign": sum(r[8] for r in outside if r[4] == "FOR"),
            "foreign_goals": sum(r[6] for r in outside if r[4] == "FOR"), "points": sum(points) / len(points) if points else None,
        }

    def expected_reason(self, move: tuple) -> str | None:
        """Label reason of a raw move row."""
        on, fee = move[2], move[8]
        if not START <= on < END:
            return "outside_study_window"
        if fee is None or fee == "?":
            return "undisclosed_fee"
        if fee == "junk":
            return "malformed_fee"
        return "zero_fee_free_or_loan" if float(fee) == 0 else None

    def expected_value(self, player: str, on: dt.date, stale: int):
        before = [(d, v) for p, d, v in self.worth if p == player and d < on]
        if not before:
            return "no_prior_valuation", None
        last = max(before)
        return ("matched", last[1]) if (on - last[0]).days <= stale else ("stale", None)


def close(a, b) -> bool:
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))
