"""All queries of the library itself."""

from spoor.plans import corpus, more, parity, security, sources, trace

QUERIES = {**security.Q, **corpus.Q, **parity.Q, **sources.Q, **more.Q, **trace.Q}
ORACLE_SQL = {**security.SQL, **corpus.SQL, **parity.SQL, **sources.SQL, **more.SQL, **trace.SQL}
