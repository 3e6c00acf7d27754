"""Role rules for nodes and edges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles in descending seniority with the degree each must exceed,
# the role of everything else, and the edge roles.
NODE_CUTOFFS = (("Executive", 500), ("Manager", 200), ("Employee", 50), ("External", 5))
LOWEST_ROLE = "Inactive"
NODE_LABELS = ("Executive", "Manager", "Employee", "External", "Inactive")
EDGE_LABELS = ("SEND", "REPLY", "BROADCAST", "INTERNAL")
SENIOR_ROLES = ("Executive", "Manager")
DEFAULT_EDGE_LABEL = "SEND"
# Fixed values of the documented alternative labelling.
PERCENTILE_ROLES = (("Influencer", 0.95), ("Community", 0.75), ("Person", 0.50), ("Organization", 0.25))
LOWEST_PERCENTILE_ROLE = "Bot"
MODULO_LABELS = ("FRIEND", "FOLLOWS", "MEMBER_OF", "INTERACTS")


def node_role(degree: Column, cutoffs=NODE_CUTOFFS) -> Column:
    """Role by degree; the cut-offs are exclusive."""
    (name, bound), *rest = cutoffs
    expr = F.when(degree > bound, F.lit(name))
    for name, bound in rest:
        expr = expr.when(degree > bound, F.lit(name))
    return expr.otherwise(F.lit(LOWEST_ROLE))


def edge_role(u_role: Column, v_role: Column) -> Column:
    """Role of an edge from the roles of its smaller and its larger endpoint, in this order."""
    u_senior = u_role.isin(*SENIOR_ROLES)
    v_senior = v_role.isin(*SENIOR_ROLES)
    return (
        F.when(u_senior & v_senior, F.lit("REPLY"))
        .when(u_senior, F.lit("BROADCAST"))
        .when(u_role == v_role, F.lit("INTERNAL"))
        .otherwise(F.lit(DEFAULT_EDGE_LABEL))
    )


def modulo_label(u: Column, v: Column) -> Column:
    """Edge label by ``(u + v) mod 4``."""
    names = F.array(*[F.lit(name) for name in MODULO_LABELS])
    return F.element_at(names, (F.pmod(u + v, F.lit(len(MODULO_LABELS))) + 1).cast("int"))
