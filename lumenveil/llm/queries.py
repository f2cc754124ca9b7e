"""Registered queries of this subpackage."""

from lumenveil.llm.handwritten import p6_found, p6_labels
from lumenveil.llm.leakage import p7_found
from lumenveil.llm.mixing import p8_mixture, p8_shares
from lumenveil.llm.parse_errors import p1_found, p1_rates, p1_repairs
from lumenveil.llm.pii_groups import P3_SQL, p3_found
from lumenveil.llm.reading import p9_found, p9_levels, p9_profile

QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_repairs": p1_repairs, "p3_found": p3_found, "p6_found": p6_found, "p6_labels": p6_labels, "p7_found": p7_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}
SQL: dict[str, str] = {"p3_found": P3_SQL}
