"""postmill: mailbox and message-corpus analytics as Spark DataFrame jobs.

Layout
------
``functions``  Column -> Column expressions, no session needed.
``operators``  DataFrame -> DataFrame steps; some write a narrow intermediate to the shared folder.
``sources``    readers, and tables derived from the sample star schema.
``sinks``      writers for the export formats.
``streaming``  Structured Streaming forms of the batch steps.
``plans``      the two user-level jobs and the named query list.
"""

from postmill.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
