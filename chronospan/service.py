"""What a front end asks for, as plain values: inputs are checked here, plans run in the operators."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronospan.operators import asof, cases, explore, movement
from chronospan.sources.store import Built

MOST_ROWS, USUAL_ROWS = 1000, 400
_GENE, _ALLELE = re.compile(r"[A-Za-z0-9_.-]{1,32}"), re.compile(r"[A-Za-z0-9_.:-]{1,80}")


class BadRequest(ValueError):
    """An input of the wrong form."""


def _rows(df: DataFrame) -> list[dict]:
    return [{k: v.isoformat() if isinstance(v, date) else v for k, v in r.asDict().items()} for r in df.collect()]


def day(text: str) -> str:
    try:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
            raise ValueError
        return date.fromisoformat(text).isoformat()
    except ValueError:
        raise BadRequest(f"not a date: {text!r}") from None


def gene(text: str) -> str:
    if not _GENE.fullmatch(text):
        raise BadRequest(f"not a gene: {text!r}")
    return text.upper()


class Timeline:
    """One panel of a built timeline; events are read from its stored steps."""

    def __init__(self, built: Built, panel: str, threshold: float):
        own = F.col("panel") == panel
        self.panel, self.releases, self.spans = panel, built.releases.where(own), built.spans.where(own)
        self.events = movement.detected(built.steps.where(own), threshold)
        self.suspects = movement.suspect_keys(self.events)

    def context(self, on: str | None = None) -> dict:
        """QRY-21"""
        floor = self.spans.agg(F.min("valid_from")).first()[0]
        if floor is None:
            return {"panel": self.panel, "releases": [], "genes": [], "headline": None, "floor": None, "events": []}
        on = day(on) if on else floor.isoformat()
        headline = explore.panel_headline(self.spans, on).first()
        dates = [r[0].isoformat() for r in self.releases.select("release_date").orderBy("release_date").collect()]
        return {
            "panel": self.panel, "releases": dates, "genes": _rows(explore.genes_ranked(self.spans, on)), "headline": headline.asDict() if headline else None, "floor": floor.isoformat(),
            "events": _rows(self.events.orderBy(F.desc("share"), "from_date", "from_bucket", "to_bucket")),
        }

    def variants(self, of: str, on: str, only_moved: bool = False, q: str | None = None, limit: int = USUAL_ROWS, offset: int = 0) -> dict:
        if not 1 <= limit <= MOST_ROWS or offset < 0:
            raise BadRequest("limit or offset out of range")
        rows = explore.variants(self.spans, gene(of), day(on), self.suspects, only_moved, q)
        headline = explore.gene_headline(self.spans, gene(of), day(on), self.suspects).first()
        return {"rows": _rows(explore.page(rows, limit, offset).drop("total")), "total": explore.total_of(rows).first()[0], "headline": headline.asDict() if headline else None}

    def composition(self, of: str) -> list[dict]:
        return _rows(asof.composition_wide(self.spans, self.releases, gene(of)).orderBy("release_date"))

    def timeline(self, allele: str) -> list[dict]:
        if not _ALLELE.fullmatch(allele):
            raise BadRequest(f"not an allele: {allele!r}")
        return _rows(asof.history(self.spans, allele).orderBy("valid_from"))

    def case_report(self, own: DataFrame, tenant: str, limit: int = USUAL_ROWS) -> dict:
        rows = cases.reconciled(own, self.spans, tenant, self.suspects)
        counts = cases.report(rows).first()
        return {"counts": counts.asDict() if counts else None, "findings": _rows(cases.findings(rows).limit(limit))}
