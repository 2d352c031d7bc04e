"""The same results in plain SQL, for checking."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle import detectors, findings, misc, streams, supply

    parts = {**detectors.sql(), **findings.sql(), **supply.sql(), **streams.sql(), **misc.sql()}
    # The reports of the whole scan are those of its parts.
    parts["fleet_scan_reports"] = (f"SELECT i.scan_id, i.iam_score, i.iam_level, s.score AS supply_score, s.level AS supply_level FROM ({parts['iam_s_scores']}) i "
                                   f"JOIN ({parts['supc_10_scores']}) s ON s.scan_id = i.scan_id")
    parts["fleet_scan_health"] = ("SELECT 'osv' AS detector, 'No advisory snapshot for PyPI; its vulnerabilities were not checked.' AS reason, 3 AS ord, "
                                  f"count(DISTINCT scan_id) AS n FROM ({parts['dep_3_requirements']})")
    return parts
