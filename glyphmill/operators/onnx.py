"""Detection and recognition models from ONNX files, run as the settings say."""

from __future__ import annotations

import os

import numpy as np

from glyphmill.operators.recognition import PackedPixels
from glyphmill.sources.config import Runtime, Settings


def session(path: str, runtime: Runtime):
    """A model ready to run. Threads, streams, latency or throughput, pinning and the cache folder follow the runtime settings.

    A device that the installed runtime has no provider for is an error; hyper-threading is left to the operating system.
    """
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = runtime.numThreads
    options.inter_op_num_threads = runtime.numStreams
    options.execution_mode = ort.ExecutionMode.ORT_SEQUENTIAL if runtime.performanceHint.upper() == "LATENCY" else ort.ExecutionMode.ORT_PARALLEL
    options.add_session_config_entry("session.intra_op.allow_spinning", "1" if runtime.enableCpuPinning else "0")
    if runtime.cacheDir:
        os.makedirs(runtime.cacheDir, exist_ok=True)
        options.optimized_model_filepath = os.path.join(runtime.cacheDir, os.path.basename(path) + f".{os.getpid()}.optimised.onnx")
    provider = f"{runtime.device.upper()}ExecutionProvider"
    if provider not in ort.get_available_providers():
        raise ValueError(f"no provider for device {runtime.device}; there are {ort.get_available_providers()}")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return ort.InferenceSession(path, options, providers=[provider])


class _Model(PackedPixels):
    def __init__(self, path: str, runtime: Runtime) -> None:
        self.session = session(path, runtime)
        self.input = self.session.get_inputs()[0].name

    def run(self, tensor: np.ndarray) -> np.ndarray:
        return self.session.run(None, {self.input: tensor.astype(np.float32)})[0]


class OnnxDetector(_Model):
    """Maps of text probabilities, (1, 1, h, w) for a tensor of (1, 3, h, w)."""

    def __init__(self, settings: Settings) -> None:
        super().__init__(settings.models.detectionModelPath, settings.runtime)

    def probabilities(self, tensor: np.ndarray) -> np.ndarray:
        return self.run(tensor)[0, 0]


class OnnxRecogniser(_Model):
    """Class scores, (n, steps, classes) for a tensor of (n, 3, h, w)."""

    def __init__(self, settings: Settings) -> None:
        super().__init__(settings.models.recognitionModelPath, settings.runtime)

    def class_scores(self, tensor: np.ndarray) -> np.ndarray:
        return self.run(tensor)
