from docweave.sources.tables import Tables

__all__ = ["Tables"]
