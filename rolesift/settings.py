"""Run settings: frozen dataclasses that become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default search profile. They decide which rows are kept and how they score.
DEFAULT_ROLES = (
    "Applied AI Engineer",
    "AI Engineer",
    "GenAI Engineer",
    "LLM Engineer",
    "Machine Learning Engineer",
    "AI Platform Engineer",
    "AI Infrastructure Engineer",
    "AI Automation Engineer",
    "AI Backend Engineer",
    "ML Engineer",
)
DEFAULT_EXCLUDE_WORDS = (
    "frontend",
    "front-end",
    "marketing",
    "recruiter",
    "human resources",
    " hr ",
    "sales",
    "account executive",
    "finance",
    "accounting",
    "customer success",
    "customer support",
    "qa engineer",
    "quality assurance",
    "test engineer",
    "product manager",
    "program manager",
)
DEFAULT_INTERNSHIP_WORDS = ("intern", "internship", "co-op", "trainee")
DEFAULT_KEYWORDS = (
    "python",
    "llm",
    "genai",
    "generative ai",
    "langchain",
    "langgraph",
    "rag",
    "retrieval augmented generation",
    "vector database",
    "pinecone",
    "weaviate",
    "faiss",
    "pytorch",
    "tensorflow",
    "openai",
    "anthropic",
    "claude",
    "gpt",
    "prompt engineering",
    "fine-tuning",
    "transformers",
    "huggingface",
    "mlops",
    "agentic",
    "ai agent",
)
DEFAULT_COUNTRIES = ("India", "Remote", "Global remote")


@dataclass(frozen=True)
class Profile:
    max_years: int = 3
    countries: tuple[str, ...] = ()
    remote_preference: str = "soft"  # strong | soft | none
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Roles:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_internships: bool = False
    internship_words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limits:
    per_company: int = 5
    top_n: int = 20
    min_stars: int = 3
    worth_looking: int = 30
    first_run_lookback_days: int = 3


@dataclass(frozen=True)
class Settings:
    profile: Profile = field(default_factory=Profile)
    roles: Roles = field(default_factory=Roles)
    limits: Limits = field(default_factory=Limits)
    feeds: tuple[str, ...] = ("weworkremotely", "remoteok", "himalayas", "jobicy")


def default_settings() -> Settings:
    """The profile a daily run uses unless the caller passes another one."""
    return Settings(
        profile=Profile(1, DEFAULT_COUNTRIES, "strong", DEFAULT_KEYWORDS),
        roles=Roles(DEFAULT_ROLES, DEFAULT_EXCLUDE_WORDS, False, DEFAULT_INTERNSHIP_WORDS),
        limits=Limits(per_company=5, top_n=30, min_stars=3, worth_looking=30),
    )
