"""What a responder is asked."""

from __future__ import annotations

import json
from collections.abc import Sequence

#: Columns shown at most, and characters of an earlier answer shown at most.
SHOWN_COLUMNS, SHOWN_ANSWER = 500, 4000

_TASK = """\
Describe what the columns of a numeric table mean, as one JSON object and nothing else. Use only the column names listed between
the two markers; don't invent any.

COLUMNS BEGIN
{columns}
COLUMNS END

The object has these keys: name, patterns, ontology, ref_templates, family_selectors, binder_enumerate, cell_codec, noisy_kind,
demand_kind, link_marker_direction, notes.
- patterns: objects with name, matcher ("regex"), kind, direction, regex (anchored, named groups), node_groups, source_group,
  destination_group, peer_group, token_groups.
- ontology: binders (list), ref_roles and fam_roles (each a map from binder to a list of roles), ops, agg_kinds.
- ref_templates: objects with binder, role, template. family_selectors: objects with binder, family_role, match_kind,
  match_direction, predicates. binder_enumerate: a map from binder to strategy.

Conventions:
1. Binder cell (strategy per_measured_col) has the role self with the template {{col}} and no families.
2. Binder node (per_node) has a role measurement_<direction> for each measured direction of single entities, with the template
   <measured kind>_{{X}}_<direction>. Binder network (singleton) has a family all_measurement_<direction> for each.
3. A pair matrix has the direction demand: node role demand_self, node families demand_row (source==X, destination!=X) and
   demand_col (destination==X, source!=X), network family all_demand (source!=@destination). Entity tokens may hold dots or
   hyphens: match whole tokens, by an escaped alternation of all entities if need be.
4. Each measured direction between two entities has a pattern of its own, with the full middle token as direction; the first
   entity is source_group, the second peer_group. Binder link (per_directed_link) has roles o0, o0_rev, o1, o1_rev ... for the
   sorted directions, with the templates <measured kind>_{{X}}_<direction>_{{Y}} and its reverse, and demand and demand_rev if
   there is a pair matrix. link_marker_direction is the first of them. Node families fam_<direction> have source==X.
5. Leave out metadata such as timestamps and labels. Keep the spelling of kinds and directions.
6. cell_codec is {{"kind": "dict_gt_hidden", "primary": "ground_truth", "clean": "hidden_ground_truth"}};
   ops are ["~=", "==", "!=", "<=", ">=", "<|>"]; agg_kinds are ["SUM", "MIN", "MAX", "AVG"].
"""


def schema_prompt(columns: Sequence[str]) -> str:
    return _TASK.format(columns="\n".join(list(columns)[:SHOWN_COLUMNS]))


def _again(what: str, task: str, answer: object, error: Exception) -> str:
    shown = (answer if isinstance(answer, str) else json.dumps(answer, default=str))[:SHOWN_ANSWER]
    return f"{what}\n\nError: {type(error).__name__}: {error}\n\nThe task was:\n{task}\n\nThe answer began:\n{shown}"


def invalid_prompt(task: str, answer: object, error: Exception) -> str:
    return _again("The last answer could not be read. Answer again with one valid JSON object, with double quotes and escaped backslashes.", task, answer, error)


def incomplete_prompt(task: str, answer: object, error: Exception) -> str:
    return _again(
        "The last answer is valid JSON but doesn't cover the real columns. Keep what is right; give directed measured patterns their peer_group, "
        "match demand entities as whole tokens, and let every binder have at least one binding. Answer with the whole JSON object.",
        task, answer, error,
    )
