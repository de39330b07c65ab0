"""The ``visits`` table: coded visits with planted defects, derived from ``events``.

The query uses integer arithmetic only, so the same text runs in Spark SQL
and in DuckDB. Pseudo-random draw ``k`` is a quadratic polynomial of the event
id modulo a prime. It is evaluated on the id modulo that prime, which gives
the same value and cannot overflow however large the ids are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PRIME = 1000003
DRAWS = range(1, 58)

VISIT_COLUMNS = [
    "event_id", "PatNum", "AgeInMonth", "AgeinYears", "AgeTwoPlus", "GCSEye", "GCSVerbal",
    "GCSMotor", "GCSTotal", "GCSGroup", "LOCSeparate", "LocLen", "Seiz", "SeizOccur", "ActNorm",
    "HA_verb", "HASeverity", "Vomit", "VomitNbr", "AMS", "AMSSleep", "SFxPalp", "SFxPalpDepress",
    "SFxBas", "Clav", "ClavOcc", "ClavPar", "ClavTem", "InjuryMech", "High_impact_InjSev",
    "Gender", "Ethnicity", "Race", "CTDone", "EDCT", "Finding6", "Finding11", "PosCT",
    "PosIntFinal", "HospHead", "HospHeadPosCT", "Neurosurgery", "DeathTBI",
]

# Columns that depend on the draws only, then on earlier columns, level by level.
# R(k, m) stands for draw k modulo m.
LEVELS = [
    {
        "PatNum": "CASE WHEN event_id % 997 = 500 THEN NULL ELSE event_id + 1 END",
        "AgeInMonth": "CASE WHEN R(15,1000) < 20 THEN NULL WHEN R(16,1000) < 5 THEN R(6,216) + 12 ELSE R(6,216) END",
        "AgeinYears": "CAST((R(6,216) - R(6,12)) / 12 AS BIGINT)",
        "AgeTwoPlus": "CASE WHEN R(17,1000) < 5 THEN 1 WHEN R(6,216) < 24 THEN 1 ELSE 2 END",
        "GCSEye": "CASE WHEN R(19,1000) < 10 THEN 1 WHEN R(1,1000) < 10 THEN 5 WHEN R(1,1000) < 20 THEN NULL"
        " WHEN R(1,1000) < 60 THEN 3 ELSE 4 END",
        "GCSVerbal": "CASE WHEN R(19,1000) < 10 THEN 2 WHEN R(2,1000) < 5 THEN 0 WHEN R(2,1000) < 10 THEN 6"
        " WHEN R(2,1000) < 20 THEN NULL WHEN R(2,1000) < 80 THEN 4 WHEN R(2,1000) < 100 THEN 3 ELSE 5 END",
        "GCSMotor": "CASE WHEN R(19,1000) < 10 THEN 3 WHEN R(3,1000) < 10 THEN NULL WHEN R(3,1000) < 50 THEN 5 ELSE 6 END",
        "LOCSeparate": "CASE WHEN R(21,1000) >= 995 THEN NULL WHEN R(21,1000) < 850 THEN 0 WHEN R(21,1000) < 950 THEN 1 ELSE 2 END",
        "Seiz": "CASE WHEN R(24,1000) < 20 THEN 1 ELSE 0 END",
        "ActNorm": "CASE WHEN R(26,1000) < 100 THEN 0 WHEN R(26,1000) < 130 THEN NULL ELSE 1 END",
        "HA_verb": "CASE WHEN R(6,216) < 24 THEN 91 WHEN R(27,1000) < 400 THEN 1 ELSE 0 END",
        "Vomit": "CASE WHEN R(29,1000) < 130 THEN 1 WHEN R(29,1000) < 135 THEN NULL ELSE 0 END",
        "AMS": "CASE WHEN R(19,1000) < 10 OR R(31,1000) < 130 THEN 1 ELSE 0 END",
        "SFxPalp": "CASE WHEN R(33,1000) < 20 THEN 1 WHEN R(33,1000) < 30 THEN 2 WHEN R(33,1000) >= 995 THEN NULL ELSE 0 END",
        "SFxBas": "CASE WHEN R(35,1000) < 10 THEN 1 ELSE 0 END",
        "Clav": "CASE WHEN R(36,1000) < 400 THEN 1 ELSE 0 END",
        "InjuryMech": "CASE WHEN R(40,1000) < 10 THEN NULL WHEN R(40,1000) < 300 THEN 8 WHEN R(40,1000) < 350 THEN 90"
        " ELSE 1 + R(41,12) END",
        "High_impact_InjSev": "CASE WHEN R(42,1000) < 170 THEN 1 WHEN R(42,1000) < 850 THEN 2 WHEN R(42,1000) < 990 THEN 3"
        " ELSE NULL END",
        "Gender": "1 + CASE WHEN R(43,1000) < 380 THEN 1 ELSE 0 END",
        "Ethnicity": "CASE WHEN R(44,1000) < 370 THEN NULL WHEN R(44,1000) < 470 THEN 1 ELSE 2 END",
        "Race": "CASE WHEN R(45,1000) < 540 THEN 1 WHEN R(45,1000) < 900 THEN 2 WHEN R(45,1000) < 950 THEN 90 ELSE 3 + R(46,3) END",
        "CTDone": "CASE WHEN R(47,1000) < 353 THEN 1 ELSE 0 END",
    },
    {
        "GCSTotal": "coalesce(GCSEye, 4) + coalesce(GCSVerbal, 5) + coalesce(GCSMotor, 6)"
        " - CASE WHEN R(18,1000) < 5 THEN 1 ELSE 0 END",
        "LocLen": "CASE WHEN LOCSeparate IN (1, 2) THEN (CASE WHEN R(22,1000) >= 800 THEN NULL ELSE 1 + R(23,4) END)"
        " WHEN R(22,1000) < 3 THEN 2 ELSE 92 END",
        "SeizOccur": "CASE WHEN Seiz = 1 THEN 1 + R(25,3) ELSE 92 END",
        "HASeverity": "CASE WHEN HA_verb = 1 THEN 1 + R(28,3) ELSE 92 END",
        "VomitNbr": "CASE WHEN Vomit = 1 THEN 1 + R(30,3) ELSE 92 END",
        "AMSSleep": "CASE WHEN AMS = 1 THEN R(32,2) ELSE 92 END",
        "SFxPalpDepress": "CASE WHEN SFxPalp = 1 THEN R(34,2) WHEN SFxPalp = 2 AND R(34,5) = 0 THEN 1 ELSE 92 END",
        "ClavOcc": "CASE WHEN Clav = 1 THEN (CASE WHEN R(37,1000) < 100 THEN 1 ELSE 0 END) ELSE 92 END",
        "ClavPar": "CASE WHEN Clav = 1 THEN (CASE WHEN R(38,1000) < 100 THEN 1 ELSE 0 END) ELSE 92 END",
        "ClavTem": "CASE WHEN Clav = 1 THEN (CASE WHEN R(39,1000) < 100 THEN 1 ELSE 0 END) ELSE 92 END",
        "EDCT": "CASE WHEN CTDone = 1 THEN (CASE WHEN R(48,1000) < 950 THEN 1 ELSE 0 END) WHEN R(48,1000) < 3 THEN 1 ELSE 0 END",
        "Finding6": "CASE WHEN CTDone = 1 THEN (CASE WHEN R(49,1000) < 20 THEN 1 ELSE 0 END) ELSE 92 END",
        "Finding11": "CASE WHEN CTDone = 1 THEN (CASE WHEN R(50,1000) < 50 OR SFxPalp = 1 THEN 1 ELSE 0 END) ELSE 92 END",
        "PosCT": "CASE WHEN CTDone = 1 THEN (CASE WHEN R(49,1000) < 20 AND R(51,10) > 0 THEN 1 ELSE 0 END) ELSE 92 END",
        "PosIntFinal": "CASE WHEN R(52,2000) = 0 THEN NULL WHEN R(53,1000) < 5 + 40 * AMS + 200 * SFxBas + 20 * Vomit"
        " + (CASE WHEN SFxPalp = 1 THEN 150 ELSE 0 END) + (CASE WHEN High_impact_InjSev = 3 THEN 30 ELSE 0 END) THEN 1 ELSE 0 END",
    },
    {
        "GCSGroup": "CASE WHEN (GCSTotal <= 13 AND R(20,1000) >= 5) OR (GCSTotal > 13 AND R(20,1000) < 5) THEN 1 ELSE 2 END",
        "HospHead": "CASE WHEN PosIntFinal = 1 OR R(54,1000) < 5 THEN 1 ELSE 0 END",
        "Neurosurgery": "CASE WHEN PosIntFinal = 1 AND R(56,6) = 0 THEN 1 ELSE 0 END",
        "DeathTBI": "CASE WHEN PosIntFinal = 1 AND GCSTotal < 9 AND R(57,3) = 0 THEN 1 ELSE 0 END",
    },
    {
        "HospHeadPosCT": "CASE WHEN HospHead = 1 AND (PosCT = 1 OR R(55,20) = 0) THEN 1 ELSE 0 END",
    },
]


def visits_query(events: str = "events") -> str:
    """SQL text of the visits table over a relation holding ``event_id``."""
    draws = ", ".join(
        f"(e*e*{2 * k + 3} + e*{7919 * k + 104729} + {31 * k * k}) % {PRIME} AS r{k}" for k in DRAWS
    )
    source = f"(SELECT event_id, {draws} FROM (SELECT event_id, event_id % {PRIME} AS e FROM {events}) ids) draws"
    for depth, level in enumerate(LEVELS):
        columns = ", ".join(f"{_expand(text)} AS {name}" for name, text in level.items())
        source = f"(SELECT *, {columns} FROM {source}) level{depth}"
    return f"SELECT {', '.join(VISIT_COLUMNS)} FROM {source}"


def _expand(text: str) -> str:
    return re.sub(r"R\((\d+),(\d+)\)", r"(r\1 % \2)", text)


def visits(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(visits_query("{events}"), events=events)
