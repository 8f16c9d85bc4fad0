"""Domain vocabulary as parameter tables: the relation constraints, tactics and entity kinds. All lists are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Relation type, source type, target types.
CONSTRAINTS = [
    ("use", "attacker", ["tool", "vul", "ioc"]),
    ("trigger", "victim", ["file", "ioc", "env"]),
    ("involve", "event", ["attacker", "victim"]),
    ("target", "attacker", ["victim", "asset", "env"]),
    ("has", "victim", ["asset", "env"]),
    ("exploit", "vul", ["asset", "env"]),
    ("affect", "file", ["asset", "env"]),
    ("related_to", "tool", ["vul", "ioc", "file"]),
    ("belong_to", "file", ["asset", "env"]),
    ("belong_to", "ioc", ["asset", "env"]),
]
#: Public tactic ids and names.
TACTICS = {
    "TA0043": "Reconnaissance", "TA0042": "Resource Development", "TA0001": "Initial Access", "TA0002": "Execution", "TA0003": "Persistence",
    "TA0004": "Privilege Escalation", "TA0005": "Defense Evasion", "TA0006": "Credential Access", "TA0007": "Discovery", "TA0008": "Lateral Movement",
    "TA0009": "Collection", "TA0011": "Command and Control", "TA0010": "Exfiltration", "TA0040": "Impact",
}
#: Aliases of entity types; off by default, so that results keep the types as written.
TYPE_ALIASES = {"attcker": "attacker", "actor": "attacker"}


def triples() -> list[tuple[str, str, str]]:
    """The legal (relation, source type, target type), in the order of declaration."""
    return [(relation, source, target) for relation, source, targets in CONSTRAINTS for target in targets]


def candidates() -> dict[tuple[str, str], list[str]]:
    """Relation types legal for a pair of types, in the order of declaration."""
    out: dict[tuple[str, str], list[str]] = {}
    for relation, source, target in triples():
        out.setdefault((source, target), []).append(relation)
    return out


def _values(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    """A literal table: a local relation, known to the optimiser with its size."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def constraint_table(spark: SparkSession) -> DataFrame:
    """(relation, source_type, target_type), 24 rows."""
    return _values(spark, [f"('{r}', '{s}', '{t}')" for r, s, t in triples()], "relation, source_type, target_type")


def candidate_table(spark: SparkSession) -> DataFrame:
    """(source_type, target_type, candidates), 21 rows."""
    array = lambda c: "array(" + ", ".join(f"'{x}'" for x in c) + ")"
    return _values(spark, [f"('{s}', '{t}', {array(c)})" for (s, t), c in candidates().items()], "source_type, target_type, candidates")


def tactic_table(spark: SparkSession) -> DataFrame:
    """(tactic_id, tactic_name), 14 rows."""
    return _values(spark, [f"('{k}', '{v}')" for k, v in TACTICS.items()], "tactic_id, tactic_name")
