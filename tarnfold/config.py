"""Tunables of the engine, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Names of chunk strategies and of LLM providers.
STRATEGIES = ("file", "class", "function", "fixed")
PROVIDERS = ("ollama", "openai_compatible", "extractive")
# Extensions that are indexed, with their language.
LANGUAGES = {".java": "java", ".js": "javascript", ".md": "markdown", ".py": "python", ".rb": "ruby", ".ts": "typescript"}
# Folders skipped anywhere.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", ".vscode",
    "__pycache__", "build", "dist", "node_modules", "site-packages", "venv",
)
# Lock files and endings of generated files.
SKIPPED_FILES = ("Gemfile.lock", "Pipfile.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock")
SKIPPED_ENDINGS = (".bundle.js", ".g.dart", ".min.css", ".min.js", "_pb2.py")


@dataclass(frozen=True)
class Config:
    strategy: str = "function"
    chunk_lines: int = 60
    chunk_overlap: int = 10
    max_file_bytes: int = 512 * 1024
    top_k: int = 5
    depth: int = 20
    fusion_weight: float = 0.7
    rrf_constant: int = 60
    mmr_lambda: float = 0.7
    per_file_cap: int = 0
    extract_blocks: int = 3
    provider: str = "extractive"
    confident: float = 0.30
    embed_dim: int = 64
    llm_url: str = "http://localhost:11434"
    llm_model: str = ""
    llm_key_variable: str = ""

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}")
        if self.chunk_lines < 1 or not 0 <= self.chunk_overlap < self.chunk_lines:
            raise ValueError("chunk_lines must be positive and chunk_overlap in [0, chunk_lines)")
        for name in ("fusion_weight", "mmr_lambda"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")

    def override(self, **changes) -> Config:
        """A copy with the given fields; None leaves a field alone."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
