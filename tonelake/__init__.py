"""tonelake: building, enriching and ranking catalogs of mood-annotated media on Spark."""

from tonelake.plans.prompt import plan_prompts
from tonelake.plans.ranking import rank_prompts
from tonelake.rules import Rulebook, default_rulebook
from tonelake.session import get_session

__all__ = ["Rulebook", "default_rulebook", "get_session", "plan_prompts", "rank_prompts"]
