"""Driver-side inputs: project settings, ``.env`` files, git targets and changed files."""

from __future__ import annotations

import json
import os
import re
import subprocess
from pathlib import Path


def coerce(v: str) -> bool | int | str:
    """A scalar of a settings file."""
    s = v.strip().strip("\"'")
    if s.lower() in ("true", "yes", "on"):
        return True
    if s.lower() in ("false", "no", "off"):
        return False
    return int(s) if re.fullmatch(r"-?\d+", s) else s


def parse_flat_yaml(text: str) -> dict:
    """``key: value`` lines and one level of ``- item`` lists; comments and blank lines do not count."""
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if line.lstrip().startswith("- ") and key:
            out.setdefault(key, [])
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(coerce(line.lstrip()[2:]))
        elif ":" in line:
            key, _, v = (x.strip() for x in line.partition(":"))
            out[key] = coerce(v) if v else []
    return out


def project_settings(folder: str, names: tuple[str, ...] = ("riskweave.yml", "riskweave.yaml", "riskweave.json")) -> dict:
    """The first settings file found; a broken one counts as empty."""
    for n in names:
        p = Path(folder, n)
        if p.is_file():
            try:
                text = p.read_text(encoding="utf-8", errors="replace")
                return json.loads(text) if n.endswith(".json") else parse_flat_yaml(text)
            except ValueError:
                return {}
    return {}


def load_dotenv(path: str, env: dict | None = None) -> dict:
    """Variables of a ``.env`` file; those already set win."""
    env = os.environ if env is None else env
    got = {}
    if os.path.isfile(path):
        for raw in Path(path).read_text(encoding="utf-8", errors="replace").splitlines():
            m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", raw)
            if m and not raw.lstrip().startswith("#"):
                got[m[1]] = m[2].strip("\"'")
                env.setdefault(m[1], got[m[1]])
    return got


def truthy(name: str) -> bool:
    return os.environ.get(name, "").strip().lower() in ("1", "true", "yes", "on")


def looks_remote(target: str) -> bool:
    """Whether a scan target is a repository address; an existing local path never is."""
    if os.path.exists(target):
        return False
    return bool(re.match(r"(?i)^(https?|ssh|git)://|^git@[\w.-]+:", target) or target.endswith(".git") or re.fullmatch(r"[\w.-]+/[\w.-]+", target))


def repository_url(target: str, host: str = "github.com") -> str:
    """``owner/name`` as an address; anything else unchanged."""
    return f"https://{host}/{target}.git" if re.fullmatch(r"[\w.-]+/[\w.-]+", target) else target


def host_of(url: str) -> str:
    m = re.match(r"(?i)^(?:[a-z+]+://)?(?:[^@/]*@)?([^:/]+)", url)
    return m[1].lower() if m else ""


def redact(text: str) -> str:
    return re.sub(r"(://)[^/@\s]*@", r"\1", text)


def clone(url: str, folder: str, branch: str | None = None, timeout: int = 600) -> str:
    """A shallow single-branch clone; its address never shows credentials in errors."""
    cmd = ["git", "clone", "--depth", "1", "--single-branch", *(["--branch", branch] if branch else []), url, folder]
    r = subprocess.run(cmd, capture_output=True, text=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if r.returncode:
        raise RuntimeError(redact(r.stderr.strip()))
    return folder


def changed_files(folder: str, ref: str = "HEAD") -> list[str]:
    """Files changed against ``ref`` and untracked files, sorted; none where git fails."""
    names: set[str] = set()
    for args in (["diff", "--name-only", ref], ["ls-files", "--others", "--exclude-standard"]):
        r = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        if r.returncode:
            return []
        names |= {x for x in r.stdout.splitlines() if x}
    return sorted(n for n in names if os.path.isfile(os.path.join(folder, n)))
