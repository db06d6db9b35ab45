"""Plans and results as text and JSON. 64-bit numbers are strings in JSON, which cannot carry them."""

from __future__ import annotations

import json
from dataclasses import asdict

from concordat.plans.execute import Result
from concordat.plans.plan import Plan
from concordat.plans.reverse import ReverseResult


def _portable(node: object) -> object:
    if isinstance(node, dict):
        return {k: _portable(v) for k, v in node.items()}
    if isinstance(node, (list, tuple)):
        return [_portable(v) for v in node]
    if isinstance(node, int) and not isinstance(node, bool) and abs(node) > (1 << 53) - 1:
        return str(node)
    return node


def to_json(thing: Plan | Result | ReverseResult) -> str:
    return json.dumps(_portable(asdict(thing)), indent=2)


def plan_text(plan: Plan) -> str:
    lines = []
    if plan.target:
        t = plan.target
        lines.append(f"target {t['host']}:{t['port']}/{t['database']} ({'PRODUCTION' if t['production'] else 'non-production'}) system_identifier {t['system_identifier']}{' IN RECOVERY' * t['in_recovery']}")
        if t["production"]:
            lines.append(f"  confirm with {t['confirmation']}")
    lines.append(f"tables ({len(plan.tables)}):")
    for t in plan.tables:
        state = " WILL TRUNCATE" if t["will_truncate"] else " target NOT EMPTY" if t["target_non_empty"] else ""
        lines.append(f"  {t['table']}: {t['rows']} rows, ~{t['bytes']} bytes{state}")
    lines += [f"  {s['table']}: SKIPPED ({s['reason']})" for s in plan.skipped_tables]
    lines.append(f"foreign keys checked after the load ({len(plan.foreign_keys)}):")
    lines += [f"  {fk['table']} {fk['name']} -> {fk['ref_table']}" for fk in plan.foreign_keys]
    if plan.incoming_references:
        lines.append(f"references from tables that are not copied ({len(plan.incoming_references)}):")
        lines += [f"  {fk['table']} {fk['name']} -> {fk['ref_table']}" for fk in plan.incoming_references]
    lines.append(f"sequences ({len(plan.sequences)}):")
    lines += [f"  {s['object']} ({s['table']}.{s['column']}): {'start ' + str(s['start']) if s['restart_with'] is None else 'restart with ' + str(s['restart_with'])}" for s in plan.sequences]
    lines += [f"  {s['code']}: {s['table']} {s['object']}" for s in plan.skipped_checks]
    lines.append("plan OK: no refusals" if plan.ok else f"REFUSED ({len(plan.refusals)}):")
    return "\n".join(lines + [f"  {r}" for r in plan.refusals])


def _table_lines(tables: list[dict]) -> list[str]:
    return [f"  {t['table']}: {t['rows']} rows, load {t['load_seconds']:.1f}s, verify {t['verify_seconds']:.1f}s, sha256 {t['sha256']}" for t in tables]


def result_text(result: Result) -> str:
    head = f"{'COMMITTED' if result.outcome == 'committed' else 'DRY RUN (nothing published)'} run {result.run_id}"
    return "\n".join([head, *_table_lines(result.tables), f"total {result.totals['rows']} rows in {result.totals['seconds']:.1f}s"])


def reverse_text(result: ReverseResult) -> str:
    head = f"WRITTEN {result.path} (run {result.run_id})" if result.outcome == "written" else f"DRY RUN (nothing written) run {result.run_id}"
    lines = [head, *_table_lines(result.tables), *[f"  sqlite_sequence {s['table']} = {s['seq']}" for s in result.sequences]]
    return "\n".join([*lines, f"total {result.totals['rows']} rows in {result.totals['seconds']:.1f}s", *[f"warning {w}" for w in result.warnings]])
