"""Profiles, their registry, detection by columns, and profiles as data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundrows.errors import CheckError
from soundrows.operators import rules as rule_types
from soundrows.operators.rules import Rule

RULE_KINDS: dict[str, Callable[..., Rule]] = {
    "not_null": rule_types.NotNull,
    "unique": rule_types.Unique,
    "allowed_values": rule_types.AllowedValues,
    "regex": rule_types.Regex,
    "integer": rule_types.IntegerType,
    "number": rule_types.NumericRange,
    "boolean": rule_types.BooleanType,
    "date": rule_types.DateValid,
    "consistency": rule_types.Consistency,
    "exactly_one": rule_types.ExactlyOne,
    "foreign_key": rule_types.ForeignKey,
}


@dataclass(frozen=True)
class Profile:
    """One logical table and the rules that govern it.  Extra columns are allowed."""

    key: str
    title: str
    description: str
    id_column: str
    detect_columns: tuple[str, ...]
    rules: tuple[Rule, ...]
    parent_tables: tuple[str, ...] = ()

    def match_score(self, columns: Iterable[str]) -> float:
        """Share of common columns; 0 unless all detection columns are there."""
        have, need = set(columns), set(self.detect_columns)
        return len(need) / max(len(have | need), 1) if need <= have else 0.0


def profile_from(key: str, spec: Mapping[str, Any]) -> Profile:
    """Build a profile from plain data (a dict, or parsed JSON or YAML).

    ``required`` lists columns that get a NotNull rule; every entry of ``rules`` is
    ``(kind, rule name, title, settings)`` with the kinds of ``RULE_KINDS``.
    """
    rules = [
        rule_types.NotNull(f"{key}.not_null.{c}", f"{c} is required", c)
        for c in spec.get("required", ())
    ]
    for kind, name, title, settings in spec.get("rules", ()):
        rules.append(RULE_KINDS[kind](rule_id=f"{key}.{name}", title=title, **settings))
    return Profile(
        key=key,
        title=spec.get("title", key),
        description=spec.get("description", ""),
        id_column=spec["id_column"],
        detect_columns=tuple(spec["detect"]),
        rules=tuple(rules),
        parent_tables=tuple(spec.get("parents", ())),
    )


class Registry:
    """Profiles in registration order."""

    def __init__(self, profiles: Iterable[Profile] = ()):
        self.profiles: dict[str, Profile] = {}
        for profile in profiles:
            self.register(profile)

    def register(self, profile: Profile) -> Profile:
        self.profiles[profile.key] = profile
        return profile

    def __iter__(self):
        return iter(self.profiles.values())

    def __len__(self):
        return len(self.profiles)

    def get(self, key: str) -> Profile | None:
        return self.profiles.get(key)

    def detect(self, columns: Sequence[str]) -> Profile | None:
        """The closest profile; the first registered one wins a tie."""
        best = max(self, key=lambda p: p.match_score(columns), default=None)
        return best if best is not None and best.match_score(columns) > 0 else None

    def resolve(self, columns: Sequence[str], dataset: str | None) -> tuple[Profile, bool]:
        """The named profile, or the detected one; and whether it was detected."""
        known = ", ".join(self.profiles)
        if dataset:
            profile = self.get(dataset)
            if profile is None:
                raise CheckError(f"There is no profile '{dataset}'; profiles are: {known}.")
            return profile, False
        profile = self.detect(columns)
        if profile is None:
            raise CheckError(
                f"No profile fits these columns; name one of: {known}."
            )
        return profile, True

    # -- the catalogue as data ---------------------------------------------------
    def describe(self) -> list[dict[str, Any]]:
        return [
            {
                "key": p.key,
                "title": p.title,
                "description": p.description,
                "id_column": p.id_column,
                "columns": list(p.detect_columns),
                "parent_tables": list(p.parent_tables),
                "rule_count": len(p.rules),
                "rules": [rule.describe() for rule in p.rules],
            }
            for p in self
        ]

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """One row per rule of every profile."""
        rows = [
            (p.key, position, *rule.describe().values())
            for p in self
            for position, rule in enumerate(p.rules)
        ]
        return spark.createDataFrame(
            rows,
            "dataset string, rule_index int, rule_id string, title string, "
            "category string, severity string, column string",
        )

    def profile_list(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n, p.key, p.title, p.description, p.id_column, list(p.detect_columns),
             list(p.parent_tables), len(p.rules))
            for n, p in enumerate(self)
        ]
        return spark.createDataFrame(
            rows,
            "profile_index int, dataset string, title string, description string, "
            "id_column string, columns array<string>, parent_tables array<string>, "
            "rule_count int",
        )

    def detect_many(self, listing: DataFrame, table: str, column: str) -> DataFrame:
        """Detect the profile of every table in a (table, column) listing.

        The listing is aggregated against the detection columns, so a table with a
        huge column list stays one partial aggregate; profiles are a fixed, small
        literal.  Tables that match nothing get NULL.
        """
        wide = listing.filter(F.col(column).isNotNull()).select(table, column).distinct()
        counts = wide.groupBy(table).agg(
            F.count(F.lit(1)).alias("_columns"),
            *[
                F.count_if(F.col(column).isin(*p.detect_columns)).alias(f"_common{n}")
                for n, p in enumerate(self)
            ],
        )
        candidates = []
        for n, profile in enumerate(self):
            need = len(set(profile.detect_columns))
            # All detection columns are present, so the union is the table's own list.
            score = F.when(F.col(f"_common{n}") == need, F.lit(float(need)) / F.col("_columns"))
            candidates.append(
                F.when(
                    score.isNotNull(),
                    F.struct(
                        score.alias("match_score"),
                        F.lit(-n).alias("_first"),
                        F.lit(profile.key).alias("dataset"),
                    ),
                )
            )
        best = F.array_max(F.array_compact(F.array(*candidates)))
        return counts.select(
            table, best.getField("dataset").alias("dataset"),
            F.coalesce(best.getField("match_score"), F.lit(0.0)).alias("match_score"),
        )
