"""Written tables between the stages of an operator, in the shared folder the cluster names."""

from fathom.sources.shared import folder as shared_folder
from fathom.sources.shared import written

__all__ = ["shared_folder", "written"]
