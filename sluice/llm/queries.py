"""The queries of this subpackage and their SQL, gathered from its modules."""

from sluice.llm import attribution, codes, decontaminate, language, minhash, mixture, mpegts, quality, repeats, warc

_MODULES = (repeats, attribution, quality, mpegts, decontaminate, warc, codes, language, mixture, minhash)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
