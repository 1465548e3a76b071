"""Settings as frozen records, read from JSON on the driver; keys that start with _ mean nothing and unknown ones are ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Models:
    """Files of a backend; relative paths start at the grandparent of the settings file."""

    detectionModelPath: str = "models/det/inference.onnx"
    recognitionModelPath: str = "models/rec/inference.onnx"
    characterDictPath: str = "fonts/dictionary.txt"


@dataclass(frozen=True)
class ModelNames:
    """Models that a backend finds by itself."""

    textDetectionModelName: str = ""
    textRecognitionModelName: str = ""


@dataclass(frozen=True)
class Detection:
    limitType: str = "max"
    limitSideLen: int = 640
    thresh: float = 0.15
    boxThresh: float = 0.15
    unclipRatio: float = 2.0


@dataclass(frozen=True)
class Recognition:
    imageHeight: int = 48
    maxWidth: int = 320
    batchSize: int = 6
    scoreThresh: float = 0.3


@dataclass(frozen=True)
class Runtime:
    device: str = "CPU"
    numThreads: int = 2
    numStreams: int = 1
    performanceHint: str = "LATENCY"
    enableHyperThreading: bool = False
    enableCpuPinning: bool = True
    cacheDir: str = ""
    lang: str = "en"
    enableMkldnn: bool = True
    mkldnnCacheCapacity: int = 10
    precision: str = "fp32"


@dataclass(frozen=True)
class Modules:
    useDocOrientationClassify: bool = False
    useDocUnwarping: bool = False
    useTextlineOrientation: bool = False


@dataclass(frozen=True)
class Output:
    saveVisualization: bool = True
    dropScoreThreshold: float = 0.5


@dataclass(frozen=True)
class Debug:
    enabled: bool = False


@dataclass(frozen=True)
class WarmUp:
    enabled: bool = True
    count: int = 2


@dataclass(frozen=True)
class Settings:
    models: Models
    names: ModelNames
    detection: Detection
    recognition: Recognition
    runtime: Runtime
    modules: Modules
    output: Output
    debug: Debug
    warmup: WarmUp
    root: str

    @classmethod
    def defaults(cls) -> Settings:
        return cls(Models(), ModelNames(), Detection(), Recognition(), Runtime(), Modules(), Output(), Debug(), WarmUp(), "")


#: Other spellings of keys: the prefixes of one backend's sections, and single keys.
_PREFIX = {Detection: "textDet", Recognition: "textRec"}
_ALSO = {"numThreads": "cpuThreads"}


def raw(path: str) -> dict:
    """All that a file says, unknown keys too, for a backend that passes settings on as they are."""
    file = Path(path).resolve()
    if not file.exists():
        raise FileNotFoundError(path)
    return json.loads(file.read_text(encoding="utf-8"))


def load(path: str, runtime_section: str = "runtime") -> Settings:
    """Settings of a file, with defaults for what it lacks. runtime_section: the name of the section on the model runtime."""
    file, given_all = Path(path).resolve(), raw(path)

    def of(kind, section: str):
        given = given_all.get(section, {})
        found = {}
        for f in fields(kind):
            spellings = [f.name, _ALSO.get(f.name, f.name), _PREFIX.get(kind, "") + f.name[0].upper() + f.name[1:]]
            found |= next(({f.name: given[k]} for k in spellings if k in given), {})
        return kind(**found)

    root = file.parent.parent
    models = of(Models, "models")
    models = replace(models, **{f.name: str(root / getattr(models, f.name)) for f in fields(models)})  # an absolute path stays as it is
    return Settings(models, of(ModelNames, "models"), of(Detection, "detection"), of(Recognition, "recognition"), of(Runtime, runtime_section), of(Modules, "pipeline"), of(Output, "output"), of(Debug, "debug"), of(WarmUp, "warmup"), str(root))
