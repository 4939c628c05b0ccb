"""Inference boundary: an image reference and a prompt in, a text out.

Models live outside. A backend is made once a Python worker and called with batches; the stub answers
from a hash, so that every pipeline runs and repeats without weights.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import textparse as T
from .functions import vocab as V


class Backend(Protocol):
    def generate_batch(self, images: list[str], prompts: list[str]) -> list[str]: ...


class StubBackend:
    """Deterministic answers in the format that the prompt asks for."""

    def generate_batch(self, images: list[str], prompts: list[str]) -> list[str]:
        out = []
        for image, prompt in zip(images, prompts, strict=True):
            h = hashlib.md5(f"{image}|{prompt}".encode()).digest()
            if prompt == SCORE_PROMPT:
                out.append(f"{1 + h[0] % 9}.{h[1] % 10}")
                continue
            pick = lambda values, i: values[h[i] % len(values)]  # noqa: B023, E731
            if prompt == PLACE_ONLY or prompt.startswith(PROMPTS["scene"]):
                said = {"Location": pick(V.LOCATIONS, 1)} if prompt == PLACE_ONLY else {"Activity": pick(V.ACTIVITIES, 0), "Location": pick(V.LOCATIONS, 1)}
                said |= {"Social distance": pick(V.SOCIAL_DISTANCES, 2)} if prompt.endswith(WITH_DISTANCE) else {}
            else:
                said = {"Gender": pick(V.GENDERS, 0), "Age": pick(V.AGE_GROUPS, 1), "Behaviour": pick(V.BEHAVIOURS, 2), "Attire": pick(V.ATTIRES, 3), **{a: h[4 + i] % 2 for i, a in enumerate(V.ACCESSORIES)}}
            as_json = "JSON objects" in prompt
            out.append(json.dumps({k.lower(): {"class": str(v)} for k, v in said.items()}) if as_json else "\n".join(f"{k}: {v}" for k, v in said.items()))
        return out


BACKENDS: dict[str, Callable[[], Backend]] = {"stub": StubBackend}

#: Short prompts of our own, by task.
PROMPTS = {
    "person": "Describe the marked person, one 'Label: value' a line: Gender, Age, Behaviour, BodyDisplay, BodyWeight, Musculature, Attire and seven accessory flags.",
    "scene": "Name the activity and the location of the scene, one 'Label: value' a line.",
    "parts": "Answer in JSON which parts of the marked person are visible: shoulders, waist, legs, feet, frame_filled.",
    "ocr": "Write 'Text:' and the text in the image.",
}


#: Prompt sets by name; a run chooses one by name, as it chooses a backend.
PROMPT_SETS: dict[str, dict[str, str]] = {
    "lines": PROMPTS,
    "json": PROMPTS | {"person": PROMPTS["person"].replace("one 'Label: value' a line", 'as JSON objects {"key": {"class": value}}')},
}
WITH_DISTANCE = " Name the social distance as well."
PLACE_ONLY = "Name the location, as 'Location: value'."
#: One question an attribute, as the merged ones replace them.
SINGLE_PROMPTS = {
    a: f"Name the {label} of the marked person, as '{label}: value'."
    for a, label in (("gender", "Gender"), ("age", "Age"), ("behaviour", "Behaviour"), ("body_display", "BodyDisplay"), ("body_weight", "BodyWeight"), ("muscle", "Musculature"), ("attire", "Attire"))
}
SCORE_PROMPT = "Rate the face from 1 to 10. Answer with the number only."


def scene_prompt(persons: Column, with_distance: Column, prompts: str = "lines") -> Column:
    """Prompt of a scene: activity and location, with the distance where asked for, or the location alone without persons."""
    scene = PROMPT_SETS[prompts]["scene"]
    return F.when(F.coalesce(persons, F.lit(0)) == 0, PLACE_ONLY).when(with_distance, scene + WITH_DISTANCE).otherwise(scene)


def estimate_scores(faces: DataFrame, image: str, backend: str = "stub") -> DataFrame:
    """``faces`` with ``raw`` and ``score``: the second model, asked about faces only. A shared base is the same backend's name."""
    asked = faces.withColumn("raw", infer(F.col(image), F.lit(SCORE_PROMPT), backend))
    return asked.withColumn("score", T.parse_score(F.col("raw")))


def deferred_scores(candidates: DataFrame, scored: DataFrame, key: list[str], image: str, backend: str = "stub") -> DataFrame:
    """The pending faces (those without a score, best picture there) scored after all classification, and the ones that had one."""
    open_ = candidates.where(F.col(image).isNotNull()).join(scored.select(*key).distinct(), key, "left_anti")
    return scored.select(*key, "score").unionByName(estimate_scores(open_, image, backend).select(*key, "score"))


def infer(image: Column, prompt: Column, backend: str | Callable[[], Backend] = "stub") -> Column:
    """Text column of a backend's answers, the backend by name or what makes one. Empty answers are asked for once more."""

    @F.pandas_udf("string")
    def asked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = (BACKENDS[backend] if isinstance(backend, str) else backend)()
        for images, prompts in batches:
            answers = model.generate_batch(images.tolist(), prompts.tolist())
            again = [i for i, a in enumerate(answers) if not (a or "").strip()]
            if again:
                for i, a in zip(again, model.generate_batch([images.iloc[i] for i in again], [prompts.iloc[i] for i in again]), strict=True):
                    answers[i] = a
            yield pd.Series(answers)

    return asked(image, prompt)


def infer_missing(work: DataFrame, known: DataFrame, key: list[str], backend: str = "stub") -> DataFrame:
    """Asks only for keys that have no answer yet, and returns old and new answers together. ``work``: key, image, prompt."""
    new = work.join(known.select(*key).distinct(), key, "left_anti").withColumn("raw", infer(F.col("image"), F.col("prompt"), backend))
    return known.select(*key, "raw").unionByName(new.select(*key, "raw"))
