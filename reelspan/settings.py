"""Settings of the engine: defaults for every key, a YAML file over them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

# The sound labels asked for by default, and the fusion weights (text, image, audio) of each query class.
EVENT_LABELS = ("gunshot", "glass breaking", "scream", "explosion", "applause", "laughter", "door slam", "car horn", "footsteps", "sirens", "phone ringing", "dog barking")
WEIGHTS = {"action": (0.30, 0.50, 0.20), "dialogue": (0.70, 0.20, 0.10), "mixed": (0.45, 0.35, 0.20)}


@dataclass(frozen=True)
class Paths:
    video_root: str = "data/videos"
    subtitle_root: str | None = None
    output_root: str = "data/output"


@dataclass(frozen=True)
class Preprocessing:
    frame_fractions: tuple[float, ...] = (0.10, 0.30, 0.50, 0.70, 0.90)
    scene_threshold: float = 27.0
    #: Only videos with this in their name; empty: all.
    name_filter: str = ""
    suffixes: tuple[str, ...] = (".mkv", ".mp4", ".avi")


@dataclass(frozen=True)
class Models:
    text_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    clip_model: str = "openai/clip-vit-base-patch32"
    device: str = "auto"
    text_embed_batch_size: int = 256


@dataclass(frozen=True)
class Audio:
    enabled: bool = False
    sample_rate: int = 16_000
    scene_audio_dir: str = "audio/scenes"
    event_labels: tuple[str, ...] = EVENT_LABELS
    top_k_events: int = 5
    model: str = "laion/clap-htsat-unfused"


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    merge_gap: float = 20.0
    weights: dict[str, tuple[float, float, float]] = field(default_factory=lambda: dict(WEIGHTS))
    character_boost: float = 0.3


@dataclass(frozen=True)
class Refinement:
    expand: float = 15.0
    bin_size: float = 2.0
    stride: float = 0.5
    min_span: float = 10.0
    max_span: float = 35.0
    bin_frames: int = 3
    smooth_window: int = 5
    snap_tolerance: float = 3.0
    expand_max_extra: float = 8.0


@dataclass(frozen=True)
class Scoring:
    calibrate_floor: float = 0.10
    calibrate_ceiling: float = 0.70
    hybrid_weight: float = 0.50
    grounding_weight: float = 0.40
    keyword_weight: float = 0.10


@dataclass(frozen=True)
class Settings:
    paths: Paths = Paths()
    preprocessing: Preprocessing = Preprocessing()
    models: Models = Models()
    audio: Audio = Audio()
    retrieval: Retrieval = Retrieval()
    refinement: Refinement = Refinement()
    pipeline: Scoring = Scoring()
    characters: tuple[str, ...] = ()

    def as_dict(self) -> dict:
        return asdict(self)


def normalised(w: tuple[float, float, float]) -> tuple[float, float, float]:
    """Weights that sum to 1; halves for text and image where they sum to nothing."""
    total = sum(w)
    return tuple(x / total for x in w) if total > 1e-8 else (0.5, 0.5, 0.0)


def settings_from(data: dict | None) -> Settings:
    """Settings of a nested mapping; missing keys have defaults, unknown ones are left out, weights are normalised."""
    out, data = Settings(), data or {}
    for f in fields(Settings):
        given = data.get(f.name)
        if given is None:
            continue
        if f.name == "characters":
            out = replace(out, characters=tuple(str(x) for x in given))
            continue
        section = getattr(out, f.name)
        known = {g.name for g in fields(section)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and k != "weights"}
        if f.name == "retrieval":
            weights = dict(WEIGHTS)
            for k, w in (given.get("weights") or {}).items():
                d = dict(zip(("text", "image", "audio"), WEIGHTS.get(k, (0.0, 0.0, 0.0))))
                d = {**d, **{x: float(y) for x, y in w.items()}} if isinstance(w, dict) else dict(zip(d, map(float, w)))
                weights[k] = (d["text"], d["image"], d["audio"])
            values["weights"] = {k: normalised(w) for k, w in weights.items()}
        out = replace(out, **{f.name: replace(section, **values)})
    return out


def load_settings(path: str | Path) -> Settings:
    """Settings of a YAML file; a missing file raises FileNotFoundError."""
    import yaml

    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(str(p))
    return settings_from(yaml.safe_load(p.read_text(encoding="utf-8")))
