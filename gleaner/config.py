"""Settings of a run, with defaults for whatever a stored document lacks."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from enum import Enum
from pathlib import Path


class Strength(str, Enum):
    """How alike two records must be; the value of ``threshold`` is in bits."""

    LOOSE = "loose"
    BALANCED = "balanced"
    STRICT = "strict"

    @property
    def threshold(self) -> int:
        return {"loose": 12, "balanced": 7, "strict": 3}[self.value]


class Profile(str, Enum):
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"

    @property
    def max_edge(self) -> int:
        return {"low": 512, "medium": 768, "high": 1024}[self.value]

    @property
    def confirm(self) -> bool:
        """Whether a second hash must agree."""
        return self is not Profile.LOW

    @property
    def faces(self) -> bool:
        return self is not Profile.LOW

    def threads(self, cpus: int) -> int:
        """Only a hint for Spark's parallelism."""
        return {"low": max(cpus // 4, 1), "medium": max(cpus * 3 // 4, 2), "high": max(cpus, 2)}[self.value]


class Scene(str, Enum):
    PORTRAIT = "portrait"
    LANDSCAPE = "landscape"


class EditStrength(str, Enum):
    SMALL = "small"
    MEDIUM = "medium"
    HIGH = "high"


# File name extensions.
RAW_EXTENSIONS = ("arw", "srf", "sr2", "nef", "nrw", "cr2", "cr3", "crw", "raf", "dng")
EXTENSIONS = (*RAW_EXTENSIONS, "jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp", "gif", "heic", "heif")
OUTPUT_FOLDERS = ("Images-Good", "Rejected")
CONFIRM_SLACK = 4

# Names in a stored settings document, where they are not the
# field's own name in camel case.
STORED_NAMES = {"scene": "sceneMode", "action": "fileAction", "profile": "perfProfile", "strength": "duplicateStrength", "extensions": "enabledExtensions", "model": "ollamaModel", "temperature": "ollamaTemperature", "telemetry": "benchmarkLogging", "full_paths": "includeFullPathsInLogs"}


def _stored_name(field: str) -> str:
    first, *rest = field.split("_")
    return STORED_NAMES.get(field, first + "".join(map(str.capitalize, rest)))


@dataclass(frozen=True)
class EngineConfig:
    scene: Scene = Scene.PORTRAIT
    action: str = "copy"
    profile: Profile = Profile.MEDIUM
    strength: Strength = Strength.BALANCED
    include_subfolders: bool = True
    extensions: tuple[str, ...] = EXTENSIONS
    enable_ai_features: bool = False
    use_ai_for_dedup: bool = False
    use_ai_for_edit: bool = False
    eye_sharpen: bool = True
    eye_sharpen_strength: EditStrength = EditStrength.MEDIUM
    vignette: bool = True
    vignette_strength: EditStrength = EditStrength.MEDIUM
    subject_blur: bool = True
    subject_blur_strength: EditStrength = EditStrength.MEDIUM
    optimal_crop: bool = True
    white_balance: bool = True
    color_tone: bool = True
    exposure_normalize: bool = True
    noise_reduction: bool = False
    model: str = ""
    temperature: float = 0.2
    telemetry: bool = False
    full_paths: bool = False
    keep_runs: int = 20
    chat_messages: int = 20
    chat_bytes: int = 32_000
    event_ring: int = 2_000

    @property
    def threshold(self) -> int:
        return self.strength.threshold

    @classmethod
    def load(cls, path: str | Path) -> EngineConfig:
        """Defaults for missing fields; a missing or broken document, or one
        with a value that a field cannot have, is all defaults.  Unknown names
        are passed over."""
        kinds = {"scene": Scene, "profile": Profile, "strength": Strength, "extensions": tuple, "eye_sharpen_strength": EditStrength, "vignette_strength": EditStrength, "subject_blur_strength": EditStrength}
        try:
            given = json.loads(Path(path).read_text())
            found = {f.name: given[_stored_name(f.name)] for f in fields(cls) if _stored_name(f.name) in given}
            for f in fields(cls):
                if f.name in found and f.name not in kinds and type(found[f.name]) is not type(f.default):
                    found[f.name] = {"float": float, "int": int}[f.type](found[f.name])
            return cls(**{k: kinds.get(k, lambda x: x)(v) for k, v in found.items()})
        except (OSError, ValueError, TypeError, KeyError, AttributeError):
            return cls()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps({_stored_name(f.name): getattr(self, f.name) for f in fields(self)}, indent=2))

    def snapshot(self) -> dict:
        """What a run's record says of its settings."""
        kept = ("scene", "profile", "strength", "action", "include_subfolders", "enable_ai_features", "use_ai_for_dedup", "model", "temperature")
        return {_stored_name(k): getattr(self, k).value if isinstance(getattr(self, k), Enum) else getattr(self, k) for k in kept}

    def ai_refusal(self) -> str | None:
        """Why a model may not be asked for edits, if one is to be."""
        return "AI-DISABLED: enable AI features before using AI" if self.use_ai_for_edit and not self.enable_ai_features else None
