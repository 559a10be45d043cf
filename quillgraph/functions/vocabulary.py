"""Words that notes use for kinds, states and weights, as they must be for right results."""

from __future__ import annotations

STATUSES = ["inbox", "ready", "queued", "in_progress", "merge_ready", "review", "done", "blocked", "paused", "someday", "cancelled", "partial"]
COMPLETED = ["done", "cancelled"]
CLOSED = ["done", "cancelled", "archived"]
BLOCKED = ["blocked"]

#: Other spellings of a status.
STATUS_ALIASES = {
    "inbox": "todo open draft early-scaffold planning seed incoming",
    "in_progress": "active in-progress in-preparation decomposing growing",
    "review": "in_review in-review ready-for-review ISSUES_FOUND conditionally-accepted revise-and-resubmit waiting invited awaiting-approval submitted",
    "merge_ready": "merge-ready",
    "done": "complete completed closed archived resolved published-spir historical accepted",
    "cancelled": "dead superseded canceled",
    "paused": "deferred dormant",
}

#: How far along a status is; the others are side states.
STATUS_RANK = {"inbox": 0, "ready": 1, "queued": 2, "in_progress": 3, "review": 4, "merge_ready": 5, "done": 6, "blocked": -1, "paused": -1, "someday": -1, "cancelled": -1, "partial": -1}

NODE_TYPES = [
    "epic", "task", "learn", "pr", "template", "goal", "target", "note", "knowledge", "memory", "insight", "observation", "contact", "document",
    "reference", "review", "case", "spec", "prototype", "index", "daily", "session-log", "audit-report",
]
TASK_TYPES = ["task", "epic", "learn", "pr"]
STRATEGIC_TYPES = ["target", "goal"]
MEMORY_TYPES = ["memory", "note", "insight", "observation"]
CONSOLIDATED_TYPES = ["epic", "task", "note", "memory", "insight", "observation"]

#: Other names of a type.
TYPE_ALIASES = {
    "task": "bug feature action milestone subproject",
    "epic": "project",
    "reference": "article reading-guide talk",
    "note": "observation insight exploration",
    "review": "review-notes peer-review",
    "spec": "design",
    "audit-report": "audit",
    "document": "instructions role agent bundle",
}

KNOWN_KEYS = (
    "id title type status priority project parent depends_on soft_depends_on blocks soft_blocks assignee complexity due created modified last_modified source confidence"
    " supersedes superseded_by permalink aliases alias order depth leaf tags children assumptions word_count date task_id archived_at classification metadata contributes_to"
    " follow_up_tasks severity goal_type consequence edge_template goals session_id issue_url release_summary progress processed processed_date triage_action triage_ref topic"
    " generated_by extracted body epic summary notes description email_date email_from email_subject step total_steps end_goal updated duration_minutes scheduled deadline version"
    " author authors reviewer venue manuscript publication journal"
).split()

#: What a stated weight counts; other words count ``OTHER_WEIGHT``.
STATED_WEIGHTS = {
    "certain": 1.0, "almost certain": 1.0, "very probable": 0.85, "probable": 0.85, "highly likely": 0.85, "expected": 0.75, "likely": 0.75, "fifty-fifty": 0.5, "even chance": 0.5,
    "uncertain": 0.25, "possible": 0.25, "perhaps": 0.25, "maybe": 0.25, "improbable": 0.15, "unlikely": 0.15, "very unlikely": 0.15, "almost impossible": 0.15, "impossible": 0.0, "none": 0.0,
}
OTHER_WEIGHT = 0.3

#: Phrases that announce acceptance criteria.
CRITERIA = r"(?i)(acceptance criteria|done when|definition of done|## ac\r?\n)"

#: An id that was made: a prefix and eight hex digits.
MADE_ID = r"(?i)^[a-z0-9][a-z0-9_-]*[_-][a-f0-9]{8}$"

#: Slugs that every registry has.
OWN_PROJECTS = ["task", "adhoc-sessions"]
