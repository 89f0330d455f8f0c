"""From raw documents to token files: toxicity, near duplicates, decontamination, mixing, token output.

STAGES lists the stages, (name, function of (spark, docs, sf_dir)); run(spark, sf_dir) applies them to documents.
"""

from folioscan.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
