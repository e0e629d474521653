"""cvloom: a Spark-native engine that turns semi-structured documents into candidate records."""

from cvloom.api import ParserError, ResumeExtractor, extract_profiles, extract_resume

__version__ = "0.2.0"
__all__ = ["ParserError", "ResumeExtractor", "extract_profiles", "extract_resume"]
