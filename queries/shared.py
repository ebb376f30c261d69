"""Expressions that derive the dirty inputs; the same text serves Spark and the oracle.

``@fmt(d)`` formats a date as month/day/year, ``@add(d,n)`` adds days.
"""

from __future__ import annotations

import re

X = "(-74.25e0 + (floor(acct) + 1000) / 16384e0)"
Y = "(40.5e0 + floor(price) / 1048576e0)"

RAW_EXPRS = {
    "event_id": "CASE WHEN k % 1009 = 3 THEN NULL WHEN k % 500 = 7 THEN CAST(k - 1 AS STRING) ELSE CAST(k AS STRING) END",
    "start_date_text": "CASE WHEN k % 97 = 0 THEN '(null)' WHEN k % 89 = 0 THEN '02/30/2020' WHEN k % 83 = 0 THEN '1/5/1901'"
                       " WHEN k % 79 = 0 THEN '12/31/2099' ELSE @fmt(odate) END",
    "start_time_text": "CASE WHEN k % 71 = 0 THEN '25:00:00' WHEN k % 67 = 0 THEN NULL ELSE"
                       " lpad(CAST(k % 24 AS STRING), 2, '0') || ':' || lpad(CAST(k % 60 AS STRING), 2, '0') || ':00' END",
    "end_date_text": "CASE WHEN k % 61 = 0 THEN NULL WHEN k % 59 = 0 THEN @fmt(@add(odate,-3)) WHEN k % 103 = 0 THEN '12/31/2099'"
                     " ELSE @fmt(@add(odate,k % 10)) END",
    "end_time_text": "'12:00:00'",
    "report_date_text": "CASE WHEN k % 53 = 0 THEN @fmt(@add(odate,-5)) ELSE @fmt(@add(odate,k % 40)) END",
    "grp_text": "CASE WHEN k % 47 = 0 THEN ' (null) ' WHEN k % 43 = 0 THEN 'ATLANTIS'"
                " WHEN k % 41 = 0 THEN '  ' || lower(replace(region, ' ', '   ')) || ' ' ELSE region END",
    "area_text": "CASE WHEN k % 37 = 0 THEN 'N/A' WHEN k % 31 = 0 THEN '12.5' WHEN k % 127 = 0 THEN 'x1' ELSE CAST(nation AS STRING) END",
    "cat_text": "CASE WHEN k % 29 = 0 THEN '' ELSE replace(priority, ' ', '  ') END",
    "cls_text": "CASE WHEN k % 23 = 0 THEN 'X' WHEN k % 151 = 0 THEN NULL ELSE lower(status) END",
    "x_text": f"CASE WHEN k % 19 = 0 THEN NULL WHEN k % 17 = 0 THEN '0' WHEN k % 13 = 0 THEN '99.5' WHEN k % 113 = 0 THEN 'abc'"
              f" ELSE CAST({X} AS STRING) END",
    "y_text": f"CASE WHEN k % 109 = 0 THEN NULL ELSE CAST({Y} AS STRING) END",
}

EVENT_EXPRS = {
    "k": "k",
    "day": "odate",
    "grp": "CASE WHEN k % 97 = 0 THEN NULL WHEN k % 211 = 0 THEN 'EUROPE' ELSE region END",
    "area": "CASE WHEN k % 89 = 0 THEN NULL ELSE CAST(nation AS STRING) END",
    "cat": "CASE WHEN k % 101 = 0 THEN NULL ELSE priority END",
    "cls": "status",
    "x": f"CASE WHEN k % 59 = 0 THEN NULL ELSE {X} END",
    "y": f"CASE WHEN k % 53 = 0 THEN 0e0 ELSE {Y} END",
}


def _replace(text: str, fmt, add) -> str:
    text = re.sub(r"@add\((\w+),([^()]*)\)", lambda m: add(m[1], m[2]), text)
    while "@fmt(" in text:
        start = text.index("@fmt(")
        depth, i = 1, start + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:start] + fmt(text[start + 5:i - 1]) + text[i:]
    return text


def spark_dialect(text: str) -> str:
    return _replace(text, lambda d: f"date_format({d}, 'MM/dd/yyyy')", lambda d, n: f"date_add({d}, CAST({n} AS INT))")


def duck_dialect(text: str) -> str:
    return _replace(text, lambda d: f"strftime({d}, '%m/%d/%Y')", lambda d, n: f"({d} + CAST({n} AS INTEGER))")
