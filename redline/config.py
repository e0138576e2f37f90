"""Parameters of a comparison."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CompareConfig:
    """Thresholds and switches; ``updated`` takes a mapping as a request or a file gives it."""

    similarity_identical: float = 0.98
    similarity_modified: float = 0.85
    align_similarity: float = 0.85
    align_similarity_bag: float = 0.70
    neighbourhood: int = 5
    context_lines: int = 1
    native_min_chars: int = 16
    native_coverage: float = 0.80
    row_tolerance: float = 3.0
    repeated_rows: int = 4
    locate_threshold: float = 0.5
    fragment_min_chars: int = 4
    char_level: bool = True
    semantic: bool = True
    render_dpi: int = 200

    def __post_init__(self) -> None:
        if not 72 <= self.render_dpi <= 600:
            raise ValueError("render_dpi must lie between 72 and 600")
        for name in ("similarity_identical", "similarity_modified", "align_similarity", "align_similarity_bag"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")

    def updated(self, options: dict) -> CompareConfig:
        """Unknown names are refused, None and '' keep the present value, others are cast to its type."""
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := sorted(set(options) - set(known)):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return replace(self, **{k: _cast(known[k], v) for k, v in options.items() if v not in (None, "")})


def _cast(kind: type, value):
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"no truth value: {value}")
        return value.lower() in ("true", "1")
    return kind(value)


#: Suffixes that an upload of each role can have.
SUFFIXES = {"word": (".docx",), "pdf": (".pdf",)}


def checked_suffix(role: str, name: str) -> str:
    """The suffix of an upload's file name; ValueError for an unknown role or a suffix that the role doesn't take."""
    suffix = name[name.rfind(".") :].lower() if "." in name else ""
    if suffix not in SUFFIXES.get(role, ()):
        raise ValueError(f"{role} takes no file named {name!r}")
    return suffix


#: Names of settings that are never shown whole.
SECRETS = ("api_key", "secret", "token", "password")


def masked(settings: dict) -> dict:
    """Settings as they may be shown: of a secret its last four characters stay, or nothing of a short one."""
    hide = lambda v: "*" * max(0, len(v) - 4) + v[-4:] if len(v) > 8 else "*" * len(v)
    return {k: hide(str(v)) if v and any(s in k.lower() for s in SECRETS) else v for k, v in settings.items()}


def merged(settings: dict, changes: dict) -> dict:
    """``settings`` after ``changes``: None and '' take a name away; a secret that comes back as it was shown stays what it is."""
    shown = masked(settings)
    out = dict(settings)
    for k, v in changes.items():
        if v in (None, ""):
            out.pop(k, None)
        elif not (k in settings and v != settings[k] and v == shown[k]):
            out[k] = v
    return out
