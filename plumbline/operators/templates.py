"""Attacks as data: templates that become column expressions, and their texts for every target they apply to."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: $$, $name, ${name}, or a $ that is none of these.
_PART = re.compile(r"\$(?:(?P<escape>\$)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|\{(?P<braced>[A-Za-z_][A-Za-z0-9_]*)\}|(?P<lone>))", re.ASCII)

#: The largest bank whose templates are read as expressions.
MAX_BANK = 1000
#: Columns that hold a target's baseline, entry and front while its attacks are written.
BASELINE, ENTRY, FRONT = "_pl_baseline", "_pl_entry", "_pl_front"


def parts(text: str) -> list[tuple[str | None, str]]:
    """(name or null, text as written) pieces of a template, in order; $$ gives $, and any other $ without a name stands for itself."""
    out, at = [], 0
    for found in _PART.finditer(text):
        name = found["name"] or found["braced"]
        out += [(None, text[at : found.start()]), (name, found[0]) if name else (None, "$")]
        at = found.end()
    return [p for p in [*out, (None, text[at:])] if p[1]]


def names(text: str) -> list[str]:
    """Names in a template, in order, each once."""
    return list(dict.fromkeys(name for name, _ in parts(text) if name))


def fill(text: str, values: Mapping[str, Column], strict: bool = True) -> Column:
    """The template with values in the places of names; null where a value is null.

    A name without a value is an error here and now; with strict=False it stays as it stands.
    """
    unknown = [n for n in names(text) if n not in values]
    if unknown and strict:
        raise ValueError(f"unknown names {', '.join(unknown)}; there are {', '.join(sorted(values))}")
    return F.concat(F.lit(""), *[values[name].cast("string") if name in values else F.lit(written) for name, written in parts(text)])


@dataclass(frozen=True)
class Attack:
    """A template attack: the check of an oracle that has to catch it, and facts that its target needs."""

    id: str
    oracle: str
    check: str
    template: str
    requires: tuple[str, ...] = ()
    description: str = ""
    origin: str = "bank"
    notes: str = ""

    def __post_init__(self) -> None:
        wrong = [f"no {n}" for n in ("id", "oracle", "check", "template") if not getattr(self, n)]
        if wrong:
            raise ValueError(f"attack {self.id or '?'}: {', '.join(wrong)}")


def bank(rows: DataFrame) -> list[Attack]:
    """Attacks of rows(id, oracle, check, template, ...), by id; of no more than MAX_BANK rows, and no id twice."""
    columns = [c for c in Attack.__dataclass_fields__ if c in rows.columns]
    got = rows.select(*columns).limit(MAX_BANK + 1).collect()
    if len(got) > MAX_BANK:
        raise ValueError(f"a bank has at most {MAX_BANK} templates")
    known: dict[str, Attack] = {}
    for row in got:
        given = {k: tuple(v) if k == "requires" else v for k, v in row.asDict().items() if v is not None}
        lacking = [n for n in ("id", "oracle", "check", "template") if n not in given]
        if lacking:
            raise ValueError(f"attack {given.get('id', '?')}: no {', '.join(lacking)}")
        if given["id"] in known:
            raise ValueError(f"there are two attacks {given['id']}")
        known[given["id"]] = Attack(**given)
    return [known[i] for i in sorted(known)]


def _front(baseline: Column, entry: Column) -> Column:
    """(text, error): the baseline, its entry kept under _HONEST; what of an attack's text is the same for all of a target's attacks."""
    error = (
        F.when(F.trim(F.coalesce(entry, F.lit(""))) == "", "no entry")
        .when(~F.coalesce(baseline, F.lit("")).rlike(r"\S"), "no baseline")
        .when(~F.contains(baseline, entry), F.concat(F.lit("the baseline has no "), entry))
    )
    ended = F.when(baseline.endswith("\n"), baseline).otherwise(F.concat(baseline, F.lit("\n")))
    return F.struct(F.concat(ended, F.lit("\n_HONEST = "), entry, F.lit("\n\n")).alias("text"), error.alias("error"))


def _whole(front: Column, header: Column, body: Column) -> Column:
    return F.concat(header, F.lit("\n"), front["text"], F.regexp_replace(body, r"\A\s+|\s+\z", ""), F.lit("\n"))


def assemble(baseline: Column, entry: Column, header: Column, body: Column) -> Column:
    """(text, error): header, baseline, the baseline's entry kept under _HONEST, body; a baseline that is blank or lacks the entry is an error."""
    front = _front(baseline, entry)
    return F.struct(F.when(front["error"].isNull(), _whole(front, header, body)).alias("text"), front["error"].alias("error"))


def instantiate(targets: DataFrame, attacks: Sequence[Attack], values: Mapping[str, Column], facts: Mapping[str, Column], baseline: Column, entry: Column) -> DataFrame:
    """targets with (attack, oracle, check, attack_text, why_not), a row for each attack: one scan, no join. Columns of these names give way.

    why_not names the first fact that doesn't hold (null counts as not), the first
    name without a value, or what is wrong with the baseline; then attack_text is null.
    Unknown names and facts, in any attack, are an error before any row is read.
    """

    def row(attack: Attack) -> Column:
        unknown = [r for r in attack.requires if r not in facts]
        if unknown:
            raise ValueError(f"attack {attack.id} requires {', '.join(unknown)}; there are {', '.join(sorted(facts))}")
        try:
            body = fill(attack.template, values)
        except ValueError as wrong:
            raise ValueError(f"attack {attack.id}: {wrong}") from wrong
        line = lambda text: " ".join(text.split())
        header = F.lit(f"# attack: {line(attack.id)}\n# {line(attack.description)}\n# to be caught by: {attack.oracle}/{attack.check}\n")
        unmet = [F.when(~F.coalesce(facts[r], F.lit(False)), f"not {r}") for r in attack.requires]
        empty = [F.when(values[n].isNull(), f"no value for {n}") for n in names(attack.template)]
        why_not = F.coalesce(*unmet, *empty, front["error"])
        return F.struct(F.lit(attack.id).alias("attack"), F.lit(attack.oracle).alias("oracle"), F.lit(attack.check).alias("check"), F.when(why_not.isNull(), _whole(front, header, body)).alias("attack_text"), why_not.alias("why_not"))

    front = F.col(FRONT)
    added = ["attack", "oracle", "check", "attack_text", "why_not"]
    kept = [F.col(f"`{c}`") for c in targets.columns if c not in added]
    if not attacks:
        return targets.select(*kept, *[F.lit(None).cast("string").alias(c) for c in added]).where("false")
    # columns of their own: else every mention of the baseline, in every attack, would work it out again
    fronted = targets.withColumns({BASELINE: baseline, ENTRY: entry}).withColumn(FRONT, _front(F.col(BASELINE), F.col(ENTRY)))
    return fronted.select(*kept, F.inline(F.array(*map(row, attacks))))
