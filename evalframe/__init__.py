"""evalframe: model evaluation expressed as Spark DataFrame plans.

Layout
------
``sources``    readers for item / few-shot files and image assets
``sinks``      JSON Lines and partitioned result / score writers
``functions``  ``Column -> Column`` expressions (parsing, prompts, chat, assets, params)
``operators``  ``DataFrame -> DataFrame`` transforms (metrics, few-shot, runs, responder)
``plans``      end-to-end evaluation plans and the fixtures derived from the driver tables
``streaming``  incremental scoring of result files as they arrive
"""

from evalframe.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
