from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def d(text: str | None) -> date | None:
    return date.fromisoformat(text) if text else None


FACTS = "symbol string, taxonomy string, concept string, unit string, start date, end date, filed date, form string, accn string, val double, pos long"


def fact(start, end, val, filed="2026-08-01", form="10-Q", concept="Revenues", unit="USD", taxonomy="us-gaap", symbol="X", accn="test", pos=0):
    return (symbol, taxonomy, concept, unit, d(start), d(end), d(filed), form, accn, None if val is None else float(val), pos)


def facts(spark, *rows):
    return spark.createDataFrame([(*row[:-1], index) for index, row in enumerate(rows)], FACTS)


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
