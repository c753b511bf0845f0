"""Who says a paragraph, and in whose voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import strip

NARRATOR, DIALOGUE = "narrator", "dialogue"

# How dialogue opens, how a line names its speaker, and the verbs of a narrator's tag.
OPENERS = ('"', "'", "„", "“", "”", "«", "»", "—", "–", "- ", "‒")
LABEL = r"(?U)^([A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻ][\w'\-. ]{0,30}?)\s*:\s+(\S.*)$"
ATTRIBUTION = r"(?iU)(powiedzia\w+|rzek\w+|odpar\w+|szepn\w+|krzykn\w+|zapyta\w+|mrukn\w+|said|asked|replied|whispered|shouted|muttered)"
SHORT_LINE = 60


def _opens(text: Column) -> Column:
    return text.rlike("^(" + "|".join(OPENERS) + ")")


def is_dialogue(paragraph: Column) -> Column:
    """RL-01: opens like dialogue or names a speaker, in the cast or not."""
    text = strip(F.coalesce(paragraph, F.lit("")))
    return (text != "") & (_opens(text) | text.rlike(LABEL))


def normalise_speaker(name: Column) -> Column:
    """RL-03: a speaker's name as a key of the cast."""
    bare = F.regexp_replace(F.lower(strip(name)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)[\s_]+", "-"), "^-+|-+$", "")


def assign_role(paragraph: Column, cast: Column) -> Column:
    """RL-02: struct<role, is_dialogue, speaker, text>; text only where a speaker's label was taken off.

    cast: array of roles that have a voice."""
    text = strip(F.coalesce(paragraph, F.lit("")))
    said = strip(F.regexp_extract(text, LABEL, 2))
    speaker = F.when(text.rlike(LABEL), normalise_speaker(F.regexp_extract(text, LABEL, 1)))
    known = F.coalesce(F.array_contains(cast, speaker), F.lit(False))
    labelled = speaker.isNotNull() & (known | _opens(said))
    tag = (F.length(text) < SHORT_LINE) & text.rlike(ATTRIBUTION)
    role = F.when(labelled, F.when(known, speaker).otherwise(DIALOGUE)).when(_opens(text) & ~tag, DIALOGUE).otherwise(NARRATOR)
    return F.struct(role.alias("role"), (labelled | (_opens(text) & ~tag)).alias("is_dialogue"), F.when(labelled, speaker).alias("speaker"), F.when(labelled, said).alias("text"))


def resolve_cast(rows: DataFrame, cast: DataFrame) -> DataFrame:
    """RL-04: rows with `role` get its `voice`, or the narrator's. cast (role, voice) is a small table."""
    narrator = cast.filter(F.col("role") == NARRATOR).agg(F.max("voice").alias("narrator_voice"))
    found = rows.join(cast, "role", "left").join(F.broadcast(narrator))
    return found.withColumn("voice", F.coalesce("voice", "narrator_voice")).drop("narrator_voice")


def override_roles(rows: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """RL-05: a role set by hand wins; an empty one removes the override."""
    set_ = overrides.filter(F.coalesce("role", F.lit("")) != "").withColumnRenamed("role", "override_role")
    return rows.join(set_, keys, "left").withColumn("role", F.coalesce("override_role", "role")).drop("override_role")


def pinned_settings(pins: Column, overrides: Column, controls: Column) -> Column:
    """RL-06: pins and overrides, the override winning, of the controls that the backend has."""
    return F.map_filter(F.map_concat(F.map_filter(pins, lambda k, v: ~F.array_contains(F.map_keys(overrides), k)), overrides), lambda k, v: F.array_contains(controls, k))


def unsupported_controls(settings: Column, controls: Column) -> Column:
    """RL-06: names of settings the backend does not have, in order."""
    return F.array_sort(F.array_except(F.map_keys(settings), controls))


def speed_setting(speed: Column, controls: Column) -> Column:
    """RL-06: a role's speed, only where it differs from 1 and the backend has the control."""
    return F.when((speed != 1.0) & F.array_contains(controls, F.lit("speed")), F.create_map(F.lit("speed"), speed)).otherwise(F.create_map().cast("map<string,double>"))


def narrator_tag(voice: Column, cast: Column) -> Column:
    """RL-07: the voice, or the cast's distinct voices in order."""
    voices = F.array_sort(F.array_distinct(F.filter(F.map_values(cast), lambda v: F.coalesce(v, F.lit("")) != "")))
    return F.when(F.coalesce(voice, F.lit("")) != "", voice).otherwise(F.array_join(voices, ", "))
