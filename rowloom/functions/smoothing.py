"""Edge weight from the frequency of a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("no", "smooth", "inverse_smooth", "inverse", "log")


@dataclass(frozen=True)
class Smoothing:
    """One of ``no``, ``smooth[,k,target]``, ``inverse_smooth[,k]``, ``inverse``, ``log[,base]``."""

    method: str = "no"
    k: float | None = None
    target: float | None = None
    eps: float = 0.01

    @classmethod
    def parse(cls, text: str) -> Smoothing:
        method, *args = [part.strip() for part in text.split(",")]
        allowed = {"no": (0,), "inverse": (0,), "smooth": (0, 2), "inverse_smooth": (0, 1), "log": (0, 1)}
        if method not in allowed:
            raise ValueError(f"unknown smoothing method {method!r}, use one of {METHODS}")
        if len(args) not in allowed[method]:
            raise ValueError(f"wrong number of smoothing parameters in {text!r}")
        numbers = [float(a) for a in args]
        if method == "smooth":
            k, target = numbers or (0.2, 200.0)
            return cls(method, k=k, target=target)
        if method == "inverse_smooth":
            return cls(method, k=numbers[0] if numbers else 0.1)
        if method == "log":
            return cls(method, target=numbers[0] if numbers else 10.0)
        return cls(method)

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown smoothing method {self.method!r}, use one of {METHODS}")
        if self.method == "smooth":
            if self.k is None or not 0 <= self.k < 1:
                raise ValueError("smoothing k must be in [0, 1)")
            if self.target is None or self.target <= 1:
                raise ValueError("smoothing target must be > 1")
        if self.method == "log" and (self.target is None or self.target <= 1):
            raise ValueError("log base must be > 1")
        if self.method == "inverse_smooth" and self.k is None:
            raise ValueError("inverse_smooth needs k")

    def weight(self, frequency: Column) -> Column:
        f = frequency.cast("double")
        if self.method == "smooth":
            step = (self.eps / (1 - self.k)) ** (1 / (1 - self.target))
            return F.lit(1 - self.k) * F.pow(F.lit(step), F.lit(1.0) - f) + F.lit(self.k)
        if self.method == "inverse_smooth":
            return F.lit(0.5) * (F.lit(2.0) - F.pow(F.lit(1 + self.k), F.lit(1.0) - f))
        if self.method == "inverse":
            return F.lit(1.0) / f
        if self.method == "log":
            return F.lit(1.0) / (F.ln(f) / F.ln(F.lit(self.target)) + F.lit(1.0))
        return F.lit(1.0)
