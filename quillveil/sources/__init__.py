"""Sources and sinks: DOCX packages, PNG images, response streams."""
