"""Array expressions as ONNX graphs, so that a Python worker can run many small matrix products as one call.

numpy calls BLAS anew for every matrix of a stack, and its exp of floats is slow on processors without
AVX-512. A graph here is written out as the protocol buffer that onnxruntime reads (its own package for
building graphs isn't needed) and runs on one thread. ``available`` is False where onnxruntime is missing.
"""

from __future__ import annotations

import importlib.util

import numpy as np

_KIND = {np.dtype(np.float32): 1, np.dtype(np.int64): 7}


def available() -> bool:
    return importlib.util.find_spec("onnxruntime") is not None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(k: int, x: int | str | bytes) -> bytes:
    if isinstance(x, int):
        return _varint(k << 3) + _varint(x & (1 << 64) - 1)
    x = x.encode() if isinstance(x, str) else x
    return _varint(k << 3 | 2) + _varint(len(x)) + x


class Graph:
    """``g(op, *inputs, **attributes)`` adds a node and names its output; arrays among the inputs are constants."""

    def __init__(self):
        self.nodes: list[bytes] = []
        self.constants: list[bytes] = []
        self.values: list[bytes] = []
        self.named = 0

    def name(self) -> str:
        self.named += 1
        return f"x{self.named}"

    def constant(self, x: np.ndarray) -> str:
        name = self.name()
        self.constants.append(_field(5, b"".join(_field(1, n) for n in x.shape) + _field(2, _KIND[x.dtype]) + _field(8, name) + _field(9, np.ascontiguousarray(x).tobytes())))
        return name

    def value(self, k: int, name: str, kind: type, rank: int) -> str:
        shape = b"".join(_field(1, _field(2, f"{name}_{i}")) for i in range(rank))
        self.values.append(_field(k, _field(1, name) + _field(2, _field(1, _field(1, _KIND[np.dtype(kind)]) + _field(2, shape)))))
        return name

    def input(self, name: str, rank: int, kind: type = np.float32) -> str:
        return self.value(11, name, kind, rank)

    def output(self, name: str, x: str, rank: int) -> None:
        self.nodes.append(_field(1, _field(1, x) + _field(2, name) + _field(4, "Identity")))
        self.value(12, name, np.float32, rank)

    def __call__(self, op: str, *inputs, outputs: int = 0, **attributes):
        names = [x if isinstance(x, str) else self.constant(x) for x in inputs]
        out = [self.name() for _ in range(outputs or 1)]
        node = b"".join(_field(1, x) for x in names) + b"".join(_field(2, x) for x in out) + _field(4, op)
        for k, x in attributes.items():
            kind, said = (2, _field(3, x)) if isinstance(x, int) else (3, _field(4, x)) if isinstance(x, str) else (7, b"".join(_field(8, i) for i in x))
            node += _field(5, _field(1, k) + said + _field(20, kind))
        self.nodes.append(_field(1, node))
        return out if outputs else out[0]

    def session(self):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        graph = b"".join(self.nodes) + _field(2, "g") + b"".join(self.constants) + b"".join(self.values)
        return onnxruntime.InferenceSession(_field(1, 8) + _field(8, _field(1, "") + _field(2, 17)) + _field(7, graph), options, providers=["CPUExecutionProvider"])
