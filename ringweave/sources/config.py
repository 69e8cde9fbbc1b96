"""Configuration files: small, read on the driver, checked strictly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.planning import mode_params

try:
    import yaml
except ImportError:  # YAML files can't be read without it; mappings still can
    yaml = None

REQUIRED = ("projects_dir", "repos_file", "cycles_file", "results_root", "experiment_id")


def read_mapping(path: str) -> dict:
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path} is no mapping")
    return got


def _text(given: dict, name: str) -> str:
    value = given.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text")
    return value.strip()


def _count(given: dict, name: str) -> int:
    value = given.get(name)
    if not isinstance(value, int) or isinstance(value, bool):
        raise ValueError(f"{name} must be a whole number")
    return value


def _block(given: dict, name: str) -> dict:
    value = given.get(name)
    if not isinstance(value, dict):
        raise ValueError(f"{name} must be a mapping")
    return value


@dataclass(frozen=True)
class LLMConfig:
    base_url: str
    api_key: str
    model_raw: str
    context_length: int


@dataclass(frozen=True)
class AgentConfig:
    runtime_image: str
    max_iters: int
    commit_message: str


@dataclass(frozen=True)
class PipelineConfig:
    projects_dir: str
    repos_file: str
    cycles_file: str
    results_root: str
    experiment_id: str
    llm: LLMConfig
    agent: AgentConfig
    modes: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]
    delete_branches: bool

    @classmethod
    def of(cls, given: dict) -> PipelineConfig:
        """A checked configuration: five texts, the blocks policy, llm and openhands, and modes."""
        policy, llm, agent = (_block(given, n) for n in ("policy", "llm", "openhands"))
        delete = policy.get("delete_refactor_branches_after_metrics")
        if not isinstance(delete, bool):
            raise ValueError("delete_refactor_branches_after_metrics must be true or false")
        if not isinstance(given.get("modes"), list):
            raise ValueError("modes must be a list")
        modes, seen = [], set()
        for m in given["modes"]:
            name = _text(m, "id")
            if name in seen:
                raise ValueError(f"mode {name} is there twice")
            seen.add(name)
            modes.append((name, tuple(sorted(mode_params(m.get("params") or {}).items()))))
        if not modes:
            raise ValueError("there are no modes")
        return cls(
            *[_text(given, n) for n in REQUIRED],
            LLMConfig(*[_text(llm, n) for n in ("base_url", "api_key", "model_raw")], _count(llm, "context_length")),
            AgentConfig(_text(agent, "runtime_image"), _count(agent, "max_iters"), _text(agent, "commit_message")),
            tuple(modes),
            delete,
        )


def analysis_plan(spark: SparkSession, given: dict) -> DataFrame:
    """mode_id, mode_label, mode_order, experiments of an analysis plan, in its order."""
    rows, seen = [], set()
    for i, m in enumerate(given.get("modes") or []):
        name, label = _text(m, "id"), _text(m, "label")
        experiments = [str(x) for x in m.get("experiments") or []]
        if name in seen or not experiments or len(set(experiments)) < len(experiments):
            raise ValueError(f"mode {name} is there twice, or its experiments are none or repeated")
        seen.add(name)
        rows.append((name, label, i, experiments))
    if not rows:
        raise ValueError("there are no modes")
    return spark.createDataFrame(rows, "mode_id string, mode_label string, mode_order int, experiments array<string>")
