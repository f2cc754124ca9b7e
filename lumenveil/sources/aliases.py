"""Identifier aliases of personal-data rules: whole identifiers and their last words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import camel_parts

#: Identifier (words joined by underscores) and the rule it stands for (fixed values).
ALIASES: dict[str, str] = {
    "mail": "email",
    "user_email": "email",
    "invite_email": "email",
    "e_mail": "email",
    "email": "email",
    "emails": "email",
    "email_address": "email",
    "email_addresses": "email",
    "from_address": "email",
    "phone": "phone_number",
    "mobile": "phone_number",
    "tel": "phone_number",
    "fax": "phone_number",
    "phone_number": "phone_number",
    "firstname": "first_name",
    "first_name": "first_name",
    "lastname": "last_name",
    "last_name": "last_name",
    "pass": "password",
    "passwd": "password",
    "user_pass": "password",
    "share_password": "password",
    "new_password": "password",
    "password": "password",
    "ssn": "ssn",
    "social_security": "ssn",
    "social_security_number": "ssn",
    "user_login": "username",
    "external_username": "username",
    "user_nicename": "username",
    "birthday": "date_of_birth",
    "bday": "date_of_birth",
    "address": "address",
}
#: First words of identifiers that name an action or a switch, not a value (fixed values).
ACTION_WORDS = (
    "has", "can", "should", "no", "hide", "show", "send", "set", "normalize", "disable", "enable", "use",
    "format", "extract", "fetch", "create", "update", "delete", "build", "handle", "mask", "sanitize", "allow", "skip", "resend",
)
#: A bare ``address`` counts only where the line declares it.
ADDRESS_DECLARED = r"(^|[^.\w])address\s*[=:;]"


def alias_rule(token: Column, line: Column, aliases: dict[str, str] | None = None) -> Column:
    """The rule an identifier stands for by its longest run of last words (three at most) in the catalog; null without one.

    Identifiers that begin with an action word stand for none.  The catalog is small by nature and becomes a literal.
    """
    table = F.create_map(*[F.lit(x) for pair in (ALIASES if aliases is None else aliases).items() for x in pair])
    words = camel_parts(token)
    n = F.size(words)
    tails = [F.when(n >= k, F.element_at(table, F.array_join(F.slice(words, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), "_"))) for k in (3, 2, 1)]
    found = F.coalesce(*tails)
    action = (n > 1) & F.element_at(words, 1).isin(*ACTION_WORDS)
    gated = (found == "address") & ((n > 1) | ~line.rlike(ADDRESS_DECLARED))
    return F.when((n > 0) & ~action & ~F.coalesce(gated, F.lit(False)), found)
