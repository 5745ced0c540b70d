"""All queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chunks, decontaminate, extract, langid, mixing, packing, secrets, simhash, warc

MODULES = (langid, decontaminate, secrets, ann, chunks, simhash, warc, extract, packing, mixing)


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: q for m in MODULES for k, q in m.ORACLES.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
