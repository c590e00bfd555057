"""Sources of text: folders of files as a Spark data source, and files of any size as numbered lines."""

from .files import FolderSource, read_folder, search_folder, search_folder_hits
from .lines import numbered, search_lines_of

__all__ = ["FolderSource", "numbered", "read_folder", "search_folder", "search_folder_hits", "search_lines_of"]
