"""Write-side operators: folding statements into a graph."""
