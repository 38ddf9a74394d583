"""Registered queries. Each module fills one table of ``name -> (query, SQL or None)``."""

from __future__ import annotations

from marketflow.plans.twins import activity, base, fits, ledger, market, prebook, results, streams

ALL = {
    **base.TWINS, **activity.TWINS, **market.TWINS, **ledger.TWINS, **fits.TWINS, **results.TWINS, **streams.TWINS, **prebook.TWINS
}
