"""The query registry: name -> Spark callable and, where SQL can say it, a check."""

from __future__ import annotations

from . import adapters as ad

QUERIES, ORACLES = {}, {}

WITH = {
    "li": ad.LI, "emb": ad.EMB.format(1, 2, 3), "boxes": ad.BOXES, "reg": ad.REGIONS, "inst": ad.INSTANCES, "sess": ad.SESSIONS, "bodies": ad.BODIES,
}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the adapter tables its SQL reads."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            head = ", ".join(f"{u} AS ({WITH[u]})" for u in uses.split())
            body = sql.strip()
            if head and body.startswith("WITH RECURSIVE "):
                body = f"WITH RECURSIVE {head}, {body[15:]}"
            elif head and body.startswith("WITH "):
                body = f"WITH {head}, {body[5:]}"
            elif head:
                body = f"WITH {head} {body}"
            ORACLES[name] = body
        return fn

    return keep
