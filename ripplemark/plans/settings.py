"""Settings of a session's analysis and its plan: what would run, what is in the way."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ripplemark.plans.model import Modulator, fraction_grid, modulator_text, parse_modulator, penalty_grid
from ripplemark.sources.files import entity

STAGES = ("selection", "glms", "trials", "summaries")
#: Stages without which a stage has nothing to work on.
NEEDS = {"summaries": ("trials",)}


@dataclass(frozen=True)
class Settings:
    """Four required fields and defaults."""

    input_dir: str
    subject: str
    session: str
    task: str
    output_dir: str | None = None
    modulators: tuple[Modulator, ...] = ()
    kernel_method: str = "cv"
    kernel_samples: int = 512
    kernel_seed: int = 0
    penalty: str = "fraction_cv"
    fractions: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    alphas: tuple[float, ...] = (0.0, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
    percentile: float = 90.0
    encoding: str = "within_run"
    noise: str = "ar1"
    denoise: bool = False
    block_size: int = 4096
    max_features: int | None = None
    skip: tuple[str, ...] = ()
    overwrite: bool = False
    extra: Mapping = field(default_factory=dict)

    def __post_init__(self):
        for name, prefix in (("subject", "sub"), ("session", "ses"), ("task", "task")):
            object.__setattr__(self, name, entity(getattr(self, name), prefix))
        if self.kernel_method not in ("cv", "reml") or self.penalty not in ("none", "ridge_cv", "fraction_cv") or self.encoding not in ("within_run", "absolute") or self.noise not in ("ols", "ar1"):
            raise ValueError("an option has no such value")
        if self.kernel_samples < 1 or self.kernel_samples & (self.kernel_samples - 1) or self.block_size < 1 or not 0 <= self.percentile <= 100:
            raise ValueError("an option is out of range")
        if set(self.skip) - set(STAGES):
            raise ValueError(f"no stage is named {sorted(set(self.skip) - set(STAGES))}")
        object.__setattr__(self, "fractions", fraction_grid(self.fractions))
        object.__setattr__(self, "alphas", penalty_grid(self.alphas))

    def stages(self) -> tuple[str, ...]:
        """Stages that run: not skipped, and with all they need."""
        out: list[str] = []
        for s in STAGES:
            if s not in self.skip and all(n in out for n in NEEDS.get(s, ())):
                out.append(s)
        return tuple(out)

    def least_runs(self) -> int:
        """Runs that the method needs: two for selection, three to tune a penalty by held-out runs with selection inside."""
        inside = self.penalty != "none" and self.kernel_method == "cv" and "selection" in self.stages()
        return 3 if inside or self.denoise else 2

    def command(self) -> list[str]:
        """The command line that gives these settings."""
        out = ["run", self.input_dir, "--subject", self.subject, "--session", self.session, "--task", self.task]
        default = Settings(self.input_dir, self.subject, self.session, self.task)
        for m in self.modulators:
            out += ["--modulator", modulator_text(m)]
        for name in ("output_dir", "kernel_method", "kernel_samples", "kernel_seed", "penalty", "percentile", "encoding", "noise", "block_size", "max_features"):
            if getattr(self, name) != getattr(default, name):
                out += ["--" + name.replace("_", "-"), str(getattr(self, name))]
        for s in self.skip:
            out += ["--skip", s]
        return out + [f"--{name}" for name in ("denoise", "overwrite") if getattr(self, name)]


def settings_from(args: Mapping) -> Settings:
    """Settings from parsed arguments; those that are None keep their defaults."""
    given = {k: v for k, v in args.items() if v is not None and k in Settings.__dataclass_fields__}
    given["modulators"] = tuple(parse_modulator(t) for t in args.get("modulator") or ())
    given["skip"] = tuple(args.get("skip") or ())
    return Settings(**given)


@dataclass(frozen=True)
class Plan:
    """What a session's analysis would do."""

    settings: Settings
    runs: tuple[int, ...]
    problems: tuple[str, ...]

    @property
    def status(self) -> int:
        return 1 if self.problems else 0


def plan(settings: Settings, names: list[str], output_exists: bool = False) -> Plan:
    """Finds the runs among file names and collects everything that would stop the analysis."""
    from ripplemark.sources.files import discover

    problems, runs = [], ()
    try:
        runs = tuple(f.run for f in discover(names, settings.subject, settings.session, settings.task))
    except ValueError as error:
        problems.append(str(error))
    if runs and len(runs) < settings.least_runs():
        problems.append(f"{len(runs)} runs; the method needs {settings.least_runs()}")
    if output_exists and not settings.overwrite:
        problems.append("the output exists")
    return Plan(settings, runs, tuple(problems))
