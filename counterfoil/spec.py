"""The job description: what to read, filter, normalise, compare and report.

``ReconSpec.from_dict`` takes the nested mapping of a job file. Everything that
can be told without reading a row is checked here, so a wrong job fails before
Spark starts a task.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Mapping as MappingABC, Sequence
from dataclasses import dataclass, field
from typing import Any

from .errors import SpecError

# Names of the job file (fixed values).
FILTER_OPERATORS = (
    "equals",
    "not_equals",
    "in",
    "not_in",
    "greater_than",
    "less_than",
    "contains",
    "matches_regex",
    "is_null",
    "is_not_null",
)
ACTIONS = ("skip", "keep")
CASE_MODES = ("lower", "upper", "title", "none")
JOIN_TYPES = ("inner", "left", "right", "outer")
METHODS = ("exact", "set", "regex", "tolerance", "segments")
COMPARE_ON = ("display", "canonical")
SECTIONS = (
    "summary",
    "mismatch_details",
    "unmatched_records",
    "per_column_breakdown",
    "normalization_log",
    "filter_log",
)
FORMATS = ("excel", "html", "csv", "markdown")
SCHEMA_VERSIONS = ("1.0",)
NULL_TOKENS = ("N/A", "NULL", "null")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _mapping(value: Any, where: str) -> MappingABC:
    _require(isinstance(value, MappingABC), f"{where} must be a mapping")
    return value


def _list(value: Any, where: str) -> list:
    _require(isinstance(value, (list, tuple)), f"{where} must be a list")
    return list(value)


def _name(value: Any, where: str) -> str:
    _require(isinstance(value, str) and value.strip() != "", f"{where} must be a non-empty text")
    return value


def _one_of(value: Any, allowed: Sequence[str], where: str) -> str:
    _require(value in allowed, f"{where}: {value!r} is not one of {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class SourceOptions:
    """Where a delimited source lies and how it is written."""

    path: str
    delimiter: str = ","
    encoding: str = "utf-8"
    quotechar: str = '"'
    use_columns: tuple[str, ...] | None = None

    @classmethod
    def from_dict(cls, source: Any, shared: MappingABC, where: str) -> "SourceOptions":
        source = _mapping(source, where)
        _name(source.get("file"), f"{where}.file")
        options = {}
        for key in ("delimiter", "encoding", "quotechar", "use_columns"):
            value = source[key] if key in source else shared.get(key)
            if value is not None:
                options[key] = tuple(_list(value, key)) if key == "use_columns" else value
        return cls(path=source["file"], **options)


@dataclass(frozen=True)
class FilterRule:
    """One row rule; ``skip`` drops the rows it matches, ``keep`` all others."""

    column: str
    operator: str
    value: Any = None
    action: str = "skip"

    def __post_init__(self) -> None:
        where = f"filter rule on {self.column!r}"
        _name(self.column, "filter rule: column")
        _one_of(self.operator, FILTER_OPERATORS, where)
        _one_of(self.action, ACTIONS, where)
        if self.operator in ("in", "not_in"):
            _require(len(_list(self.value, f"{where}: value")) > 0, f"{where}: empty value list")
        if self.operator in ("greater_than", "less_than"):
            try:
                float(self.value)
            except (TypeError, ValueError) as exc:
                raise SpecError(f"{where}: {self.value!r} is not a number") from exc
        if self.operator == "matches_regex":
            try:
                re.compile(str(self.value))
            except re.error as exc:
                raise SpecError(f"{where}: invalid pattern {self.value!r}: {exc}") from exc

    @classmethod
    def from_dict(cls, rule: Any, where: str, action_required: bool) -> "FilterRule":
        rule = _mapping(rule, where)
        needed = ["column", "operator"] + (["action"] if action_required else [])
        if rule.get("operator") not in ("is_null", "is_not_null"):
            needed.append("value")
        missing = [key for key in needed if key not in rule]
        _require(not missing, f"{where} lacks {', '.join(missing)}")
        return cls(rule["column"], rule["operator"], rule.get("value"), rule.get("action", "skip"))


@dataclass(frozen=True)
class Cleaning:
    """Cell cleaning that every column of both sources gets.

    Cleaning with any rule turns nulls into empty text. ``collapse_whitespace``
    and ``null_tokens`` are extras and off unless asked for.
    """

    trim_whitespace: bool = False
    remove_nulls: bool = False
    case_normalize: str | None = None
    collapse_whitespace: bool = False
    null_tokens: tuple[str, ...] = ()
    null_value: str = ""
    preserve_nan_text: bool = False
    rules: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.case_normalize is not None:
            _one_of(self.case_normalize, CASE_MODES, "case_normalize")

    @classmethod
    def from_dict(cls, rules: Any) -> "Cleaning | None":
        rules = _mapping(rules, "global_cleaning")
        if not rules:
            return None
        tokens = rules.get("null_tokens") or ()
        if tokens is True:
            tokens = NULL_TOKENS
        return cls(
            trim_whitespace=bool(rules.get("trim_whitespace", False)),
            remove_nulls=bool(rules.get("remove_nulls", False)),
            case_normalize=rules.get("case_normalize"),
            collapse_whitespace=bool(rules.get("collapse_whitespace", False)),
            null_tokens=tuple(tokens),
            null_value=str(rules.get("null_value", "")),
            preserve_nan_text=bool(rules.get("preserve_nan_text", False)),
            rules=tuple(rules),
        )


@dataclass(frozen=True)
class AliasGroup:
    """Values that stand for one thing, and the text shown for them."""

    name: str
    aliases: tuple[str, ...]
    display_format: str = "{normalized}"
    columns: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        _require(len(self.aliases) > 0, f"alias group {self.name!r} has no aliases")
        try:
            fields = {f for _, f, _, _ in string.Formatter().parse(self.display_format) if f is not None}
        except ValueError as exc:
            raise SpecError(f"alias group {self.name!r}: bad display_format: {exc}") from exc
        unknown = fields - {"normalized", "original"}
        _require(not unknown, f"alias group {self.name!r}: unknown fields {sorted(unknown)}")

    def lookup(self) -> dict[str, str]:
        """Lower-cased alias to alias as written; the last duplicate wins."""
        trimmed = (alias.strip() for alias in self.aliases)
        return {alias.lower(): alias for alias in trimmed if alias}

    def shown(self, alias: str) -> str:
        return self.display_format.format(normalized=self.name, original=alias)

    @classmethod
    def from_dict(cls, group: Any, where: str) -> "AliasGroup":
        group = _mapping(group, where)
        _require("normalized_name" in group, f"{where} lacks normalized_name")
        columns = group.get("columns")
        return cls(
            name=str(group["normalized_name"]),
            aliases=tuple(str(a) for a in _list(group.get("aliases"), f"{where}.aliases")),
            display_format=str(group.get("display_format", "{normalized}")),
            columns=None if columns is None else tuple(_list(columns, f"{where}.columns")),
        )


@dataclass(frozen=True)
class ColumnRule:
    """Parsing of one column: list cells or fixed-width cells."""

    column: str
    array_parse: bool = False
    lengths: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        _require(
            not (self.array_parse and self.lengths is not None),
            f"column rule on {self.column!r}: array_parse and fixed_length_parse exclude each other",
        )

    @classmethod
    def from_dict(cls, rule: Any, where: str) -> "ColumnRule":
        rule = _mapping(rule, where)
        _require("column" in rule, f"{where} lacks column")
        lengths = None
        if rule.get("fixed_length_parse"):
            lengths = tuple(int(n) for n in _list(rule.get("lengths"), f"{where}.lengths"))
        return cls(rule["column"], bool(rule.get("array_parse")), lengths)


@dataclass(frozen=True)
class UserNormalizer:
    """A caller's function on cells; see ``operators.normalize.as_column_function``."""

    name: str
    function: Any
    columns: tuple[str, ...] | None = None

    @classmethod
    def from_dict(cls, entry: Any, where: str) -> "UserNormalizer":
        entry = _mapping(entry, where)
        function = entry.get("class", entry.get("function"))
        _require(function is not None, f"{where} lacks class or function")
        columns = entry.get("columns") or None
        name = entry.get("name") or getattr(function, "__name__", str(function))
        return cls(name, function, None if columns is None else tuple(_list(columns, where)))


@dataclass(frozen=True)
class ColumnMapping:
    """A pair of columns to compare and the way to compare them."""

    column_a: str
    column_b: str
    method: str = "exact"
    compare_on: str = "display"
    pattern: str | None = None
    tolerance: str | None = None
    lengths: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        where = f"mapping {self.label!r}"
        _name(self.column_a, "mapping: source_a")
        _name(self.column_b, "mapping: source_b")
        _one_of(self.method, METHODS, where)
        _one_of(self.compare_on, COMPARE_ON, where)
        if self.method == "regex":
            try:
                re.compile(_name(self.pattern, f"{where}: pattern"))
            except re.error as exc:
                raise SpecError(f"{where}: invalid pattern: {exc}") from exc
        if self.method == "tolerance":
            _require(
                re.fullmatch(r"\d{1,35}(\.\d{1,30})?", self.tolerance or "") is not None,
                f"{where}: tolerance must be a plain number with at most 35 digits before and 30 after the point",
            )
        if self.method == "segments":
            _require(bool(self.lengths), f"{where}: segments needs lengths")

    @property
    def label(self) -> str:
        return f"{self.column_a} vs {self.column_b}"

    @classmethod
    def from_dict(cls, entry: Any, where: str) -> "ColumnMapping":
        entry = _mapping(entry, where)
        for side in ("source_a", "source_b"):
            _name(entry.get(side), f"{where}.{side}")
        tolerance = entry.get("tolerance")
        lengths = entry.get("lengths")
        return cls(
            entry["source_a"],
            entry["source_b"],
            entry.get("method", "exact"),
            entry.get("compare_on", "display"),
            entry.get("pattern"),
            None if tolerance is None else str(tolerance),
            None if lengths is None else tuple(int(n) for n in _list(lengths, f"{where}.lengths")),
        )


@dataclass(frozen=True)
class Section:
    """A part of the report and the metrics it asks for."""

    name: str
    enabled: bool = True
    stats: tuple[Any, ...] = ()

    @classmethod
    def from_dict(cls, entry: Any, where: str) -> "Section":
        entry = _mapping(entry, where)
        _require("name" in entry, f"{where} lacks name")
        stats = entry.get("stats")
        return cls(
            entry["name"],
            bool(entry.get("enabled", True)),
            tuple(stats) if isinstance(stats, (list, tuple)) else (),
        )


@dataclass(frozen=True)
class ReconSpec:
    """A whole job, checked."""

    key_a: str
    key_b: str
    mappings: tuple[ColumnMapping, ...]
    join_type: str = "inner"
    filters_a: tuple[FilterRule, ...] = ()
    filters_b: tuple[FilterRule, ...] = ()
    cleaning: Cleaning | None = None
    alias_groups: tuple[AliasGroup, ...] = ()
    logical_columns: dict[str, Any] = field(default_factory=dict)
    column_rules: tuple[ColumnRule, ...] = ()
    user_normalizers: tuple[UserNormalizer, ...] = ()
    sections: tuple[Section, ...] = ()
    outputs: tuple[tuple[str, str], ...] = ()
    sources: dict[str, SourceOptions] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _name(self.key_a, "key column of source A")
        _name(self.key_b, "key column of source B")
        _one_of(self.join_type, JOIN_TYPES, "join_type")
        names = [group.name for group in self.alias_groups]
        _require(len(names) == len(set(names)), "alias group names must differ")
        parsed = {rule.column for rule in self.column_rules if rule.array_parse}
        _require(not parsed & {self.key_a, self.key_b}, "a key column cannot be a list column")

    # -- from a job file ----------------------------------------------------

    @classmethod
    def from_dict(cls, job: Any) -> "ReconSpec":
        job = _mapping(job, "job")
        version = job.get("schema_version")
        _require(isinstance(version, str), "schema_version must be given as a text")
        _one_of(version, SCHEMA_VERSIONS, "schema_version")
        compare = _mapping(job.get("compare"), "compare")
        key_a, key_b = cls._keys(compare)
        mappings = _list(compare.get("column_mappings"), "compare.column_mappings")
        _require(len(mappings) > 0, "compare.column_mappings must not be empty")
        filters = cls._filters(job)
        rules = cls._normalisation(job)
        return cls(
            key_a=key_a,
            key_b=key_b,
            join_type=compare.get("join_type", "inner"),
            mappings=tuple(
                ColumnMapping.from_dict(m, f"column_mappings[{i}]") for i, m in enumerate(mappings)
            ),
            filters_a=filters["source_a"],
            filters_b=filters["source_b"],
            sections=cls._sections(job.get("report")),
            outputs=cls._outputs(job.get("report")),
            sources=cls._sources(job),
            **rules,
        )

    @staticmethod
    def _keys(compare: MappingABC) -> tuple[str, str]:
        pair = compare.get("key_column")
        if isinstance(pair, MappingABC):
            names = [
                _name(pair.get(side), f"key_column.{side}").strip()
                for side in ("source_a", "source_b")
            ]
            return names[0], names[1]
        names = compare.get("key_columns") or []
        _require(len(_list(names, "key_columns")) > 0, "no key_column and no key_columns")
        shared = _name(names[0], "key_columns[0]").strip()
        return shared, shared

    @staticmethod
    def _nested(job: MappingABC, section: str, key: str) -> tuple[MappingABC, bool]:
        """The mapping ``section.key`` when it is there and filled, else top-level ``key``."""
        nested = job.get(section)
        if isinstance(nested, MappingABC) and nested.get(key):
            return _mapping(nested[key], f"{section}.{key}"), True
        return _mapping(job.get(key) or {}, key), False

    @classmethod
    def _filters(cls, job: MappingABC) -> dict[str, tuple[FilterRule, ...]]:
        found, nested = cls._nested(job, "filter", "pre_filters")
        unknown = set(found) - {"source_a", "source_b"}
        _require(not unknown, f"pre_filters: unknown sources {sorted(unknown)}")
        return {
            source: tuple(
                FilterRule.from_dict(rule, f"pre_filters.{source}[{i}]", action_required=nested)
                for i, rule in enumerate(_list(found.get(source) or [], f"pre_filters.{source}"))
            )
            for source in ("source_a", "source_b")
        }

    @classmethod
    def _normalisation(cls, job: MappingABC) -> dict[str, Any]:
        rules, _ = cls._nested(job, "normalize", "normalization_rules")

        def each(key: str, build: Callable[[Any, str], Any]) -> tuple:
            entries = _list(rules.get(key) or [], key)
            return tuple(build(entry, f"{key}[{i}]") for i, entry in enumerate(entries))

        return {
            "cleaning": Cleaning.from_dict(rules.get("global_cleaning") or {}),
            "alias_groups": each("alias_groups", AliasGroup.from_dict),
            "logical_columns": dict(rules.get("column_mappings") or {}),
            "column_rules": each("column_specific", ColumnRule.from_dict),
            "user_normalizers": each("custom_normalizers", UserNormalizer.from_dict),
        }

    @staticmethod
    def _outputs(report: Any) -> tuple[tuple[str, str], ...]:
        """Format and file name of each output that the report asks for."""
        output = _mapping(_mapping(report or {}, "report").get("output") or {}, "report.output")
        found = []
        for i, entry in enumerate(_list(output.get("formats") or [], "report.output.formats")):
            entry = _mapping(entry, f"formats[{i}]")
            kind = _one_of(entry.get("type"), FORMATS, f"formats[{i}].type")
            found.append((kind, str(entry.get("file_name") or "comparison_report")))
        return tuple(found)

    @staticmethod
    def _sections(report: Any) -> tuple[Section, ...]:
        report = _mapping(report or {}, "report")
        sections = _list(report.get("sections") or [], "report.sections")
        return tuple(Section.from_dict(s, f"report.sections[{i}]") for i, s in enumerate(sections))

    @staticmethod
    def _sources(job: MappingABC) -> dict[str, SourceOptions]:
        if "sources" not in job:
            return {}
        sources = _mapping(job["sources"], "sources")
        shared = _mapping(job.get("import") or {}, "import")
        for side in ("source_a", "source_b"):
            _require(side in sources, f"sources lacks {side}")
        return {
            side: SourceOptions.from_dict(sources[side], shared, f"sources.{side}")
            for side in ("source_a", "source_b")
        }

    # -- use ----------------------------------------------------------------

    def enabled_sections(self) -> tuple[str, ...]:
        if not self.sections:
            return SECTIONS
        return tuple(section.name for section in self.sections if section.enabled)

    def requested_stats(self) -> tuple[Any, ...]:
        """Metric entries of the enabled sections, in order."""
        return tuple(stat for section in self.sections if section.enabled for stat in section.stats)

    def check(self, columns_a: Sequence[str], columns_b: Sequence[str]) -> None:
        """Raise when a key or mapped column is missing; reads no data."""
        for side, have, wanted in (
            ("A", columns_a, [self.key_a, *(m.column_a for m in self.mappings)]),
            ("B", columns_b, [self.key_b, *(m.column_b for m in self.mappings)]),
        ):
            missing = [name for name in wanted if name not in have]
            _require(not missing, f"source {side} lacks columns {missing}")
